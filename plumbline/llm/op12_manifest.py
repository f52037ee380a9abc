"""Operator 12, Merkle manifest of a table with coordinate lookup proofs (DataFrame functions only).

A row's leaf is the sha256 of its fields, each as ``<bytes>:<value>`` or ``-``. The leaves of a group, in order of id,
are folded in runs of ``arity`` until one is left, its subroot; the subroots, in order of group, give the root likewise.

1. *Places.* Leaves are range-sorted by (group, id, leaf), and a leaf's place in its group is its place in its partition
   plus what the group has in the partitions before: no window runs over a whole group.
2. *Nodes.* ``height`` levels are folded at once, within spans of arity ** height neighbours, and written as the node
   table (group, level, pos, digest); the spans' tops are the leaves of the next storey of the tree.
3. *Proofs.* From the top storey down, every node explodes the coordinates of its siblings, level by level, from its
   place and the group size, joins the node table, orders what it gets, and puts the proof of its span's top behind it.
   A node is asked for by its own span alone, so however large a group, no key of a join has more than arity ** height rows.
4. *Fold.* leaf and proof give the root again; a row whose content was changed doesn't.

Null fields have a form of their own; rows without an id come first, rows without a group form the first group. Rows
of one id are ordered by their leaves; equal rows have equal leaves, so their order can't matter. An empty table gives no rows. Texts
are read once, where the leaf is made, and are never shuffled; very long ones are hashed like others. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.store import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def leaf_hash(values: list[Column]) -> Column:
    """Digest (hex) of fields; numbers as decimals."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*(one(c) for c in values)), 256)


def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """df (key, ...) with pos, the place within the key by the columns of order, and m, the key's rows; written once, so
    that a lost task can't deal places anew."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # ties are equal in all columns, so any order of them will do; the number keeps many of them from one partition
    df = df.withColumn("tie", F.monotonically_increasing_id())
    by = ["key", *order, "tie"]
    at = df.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("tie").withColumns({"part": F.spark_partition_id(), "i": F.monotonically_increasing_id()})
    at = written(at)
    runs = at.groupBy("part", "key").agg(F.min("i").alias("start"), F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy("key")
    runs = runs.withColumns({"before": F.sum("c").over(own.orderBy("part")) - F.col("c"), "m": F.sum("c").over(own)}).drop("c")
    return at.join(runs, ["part", "key"]).withColumn("pos", F.col("i") - F.col("start") + F.col("before")).drop("part", "i", "start", "before")


def _levels(m: Column, arity: int, height: int) -> Column:
    """How many levels a storey folds of a group with m nodes."""
    return sum(((m > arity**k).cast("int") for k in range(height)), F.lit(0))


def _parents(below: Column, arity: int) -> Column:
    run = lambda j: F.array_join(F.transform(F.slice(below, j * arity + 1, arity), _hex), "")
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(below) - 1) / arity).cast("int")), lambda j: F.unhex(F.sha2(run(j), 256)))


class Tree:
    """The tree of every key. nodes: key, pos, m (nodes of the key), digest (binary)."""

    def __init__(self, nodes: DataFrame, arity: int, height: int):
        self.arity, self.height, self.storeys = arity, height, []
        span = arity**height
        most = nodes.agg(F.max("m")).first()[0] or 0
        while True:
            g = nodes.groupBy("key", F.floor(F.col("pos") / span).alias("span")).agg(F.first("m").alias("m"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"]).alias("level0"))
            for k in range(height):
                g = g.withColumn(f"level{k + 1}", F.when(_levels(F.col("m"), arity, height) > k, _parents(F.col(f"level{k}"), arity)))
            none = F.array().cast("array<binary>")

            def placed_nodes(k: int) -> Column:
                return F.transform(F.coalesce(f"level{k}", none), lambda x, j: F.struct(F.lit(k).alias("level"), (F.col("span") * arity ** (height - k) + j).alias("pos"), x.alias("digest")))

            at = [placed_nodes(k) for k in range(height + 1)]
            table = written(g.select("key", "m", F.inline(F.flatten(F.array(*at)))))
            self.storeys.append((nodes, table))
            tops = table.where(F.col("level") == _levels(F.col("m"), arity, height))
            nodes = tops.select("key", F.floor(F.col("pos") / F.lit(arity).cast("double") ** (height - F.col("level"))).alias("pos"), F.ceil(F.col("m") / span).alias("m"), "digest")
            if most <= span:
                break
            most = -(-most // span)
        self.roots = nodes.select("key", "digest")

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """(key, pos, proof) of every leaf; proof: for each level the siblings on the left and on the right. above: (key, proof), what
        leads on from each key's root; its other columns are kept."""
        g = self.arity
        up = self.roots.select("key", F.array().cast("array<struct<l:binary,r:binary>>").alias("proof")) if above is None else above
        kept = [c for c in up.columns if c != "key"]
        up = up.withColumn("pos", F.lit(0).cast("long"))
        for nodes, table in reversed(self.storeys):
            steps = F.transform(F.sequence(F.lit(0), F.lit(self.height - 1)), lambda k: F.struct(k.alias("level"), F.pow(F.lit(g), k).cast("long").alias("width")))
            asked = nodes.select("key", "pos", "m", F.inline(steps)).where("m > width")
            asked = asked.withColumns({"own": F.expr("pos div width"), "there": F.expr("(m + width - 1) div width")})
            first = F.expr(f"own - own % {g}")
            asked = asked.withColumn("at", F.explode(F.sequence(first, F.least(first + g, F.col("there")) - 1))).where("at <> own")
            asked = asked.select("key", "level", "at", "pos", (F.col("at") > F.col("own")).alias("right"))
            found = asked.join(table.select("key", "level", F.col("pos").alias("at"), "digest"), ["key", "level", "at"])
            found = found.groupBy("key", "pos").agg(F.array_sort(F.collect_list(F.struct("level", "at", "right", "digest"))).alias("found"))
            side = lambda k, right: F.unhex(F.array_join(F.transform(F.filter("found", lambda x: (x["level"] == k) & (x["right"] == right)), lambda x: _hex(x["digest"])), ""))
            levels = _levels(F.col("m"), g, self.height)
            none = F.array().cast("array<struct<l:binary,r:binary>>")
            own = F.when(levels > 0, F.transform(F.sequence(F.lit(0), F.greatest(levels - 1, F.lit(0))), lambda k: F.struct(F.coalesce(side(k, False), F.lit(b"")).alias("l"), F.coalesce(side(k, True), F.lit(b"")).alias("r")))).otherwise(none)
            got = nodes.select("key", "pos", "m").join(found, ["key", "pos"], "left").select("key", "pos", F.floor(F.col("pos") / g**self.height).alias("top"), own.alias("own"))
            up = got.join(up.select("key", F.col("pos").alias("top"), *kept), ["key", "top"]).select("key", "pos", *(F.concat("own", "proof").alias("proof") if c == "proof" else F.col(c) for c in kept))
        return up


def proof_text(proof: Column) -> Column:
    """The siblings' digests in order."""
    return F.array_join(F.transform(proof, lambda x: F.concat(_hex(x["l"]), _hex(x["r"]))), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and its proof lead to."""
    return F.aggregate(proof, leaf, lambda acc, x: F.sha2(F.concat(_hex(x["l"]), acc, _hex(x["r"])), 256))


def manifest(docs: DataFrame, changed: Column | None = None, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, count_col: str = "n_chars", arity: int = 2, height: int = 8) -> DataFrame:
    """One row per row: doc_id, leaf, subroot, root, proof, folded_root, verified. changed: of which rows the fold starts from a
    leaf whose count_col is greater by one (a drill); by default of none."""
    now = leaf_hash([F.col(f) for f in fields])
    then = leaf_hash([F.col(f) + 1 if f == count_col else F.col(f) for f in fields])
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.unhex(now).alias("digest"), F.unhex(F.when(F.lit(False) if changed is None else changed, then)).alias("other"))
    leaves = written(placed(written(leaves), ["doc_id", "digest"]))
    tree = Tree(leaves.select("key", "pos", "m", "digest"), arity, height)
    # the groups' own tree: one key, with the groups in order as leaves
    subroots = written(placed(tree.roots.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest"), ["group"]))
    upper = Tree(subroots.select("key", "pos", "m", "digest"), arity, height)
    above = written(subroots.join(upper.proofs(), ["key", "pos"]).select(F.col("group").alias("key"), "proof", F.col("digest").alias("subroot")))
    root = F.lit((upper.roots.first() or [None, None])[1]).cast("binary")
    rows = leaves.select("key", "pos", "doc_id", "digest", "other").join(tree.proofs(above), ["key", "pos"])
    out = rows.select("doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(root).alias("root"), "proof", folded(_hex(F.coalesce("other", "digest")), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def sql() -> str:
    """The registered query in DuckDB: the nodes and the folds level by level."""
    enc = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    leaf = lambda n: "sha256(" + " || ".join(enc(n if c == "n_chars" else c) for c in FIELDS) + ")"
    step = "xor(c >> 1, 3988292384 * (c & 1))"
    byte = "xor(c, x)"
    for _ in range(8):
        byte = f"list_transform([{byte}], lambda c: {step})[1]"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda d: ascii(d)::bigint)), lambda c, x: {byte}), 4294967295)"
    tree = lambda name, start, key: f"""
{name} AS (SELECT {key}, 0::bigint AS level, pos, m, digest FROM {start} UNION ALL
  SELECT {key}, level + 1, pos // 2, (m + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE m > 1 GROUP BY {key}, level, pos // 2, m)"""  # noqa: E731
    fold = lambda name, start, nodes, same: f"""
{name} AS (SELECT row, lang, 0::bigint AS level, pos, m, folded, proof FROM {start} UNION ALL
  SELECT f.row, f.lang, f.level + 1, f.pos // 2, (f.m + 1) // 2,
    sha256(CASE WHEN f.pos % 2 = 1 THEN n.digest || f.folded ELSE f.folded || coalesce(n.digest, '') END), f.proof || coalesce(n.digest, '')
  FROM {name} f LEFT JOIN {nodes} n ON {same} AND n.level = f.level AND n.pos = xor(f.pos, 1) WHERE f.m > 1)"""  # noqa: E731
    return f"""WITH RECURSIVE
leaf AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS m, row_number() OVER () AS row
  FROM (SELECT doc_id, lang, {leaf("n_chars")} AS digest, CASE WHEN doc_id IS NOT NULL AND {crc} % 7 = 0 THEN {leaf("n_chars + 1")} END AS other FROM documents)),{tree("node", "leaf", "lang")},
sub AS (SELECT 0 AS k, lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS m FROM node WHERE m = 1),{tree("top", "sub", "k")},
start AS (SELECT row, lang, pos, m, coalesce(other, digest) AS folded, '' AS proof FROM leaf),{fold("low", "start", "node", "n.lang IS NOT DISTINCT FROM f.lang")},
half AS (SELECT w.row, w.lang, s.pos, s.m, w.folded, w.proof FROM low w JOIN sub s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.m = 1),{fold("high", "half", "top", "true")}
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(h.proof) AS proof_sha256, h.folded AS folded_root, h.folded = r.digest AS verified
FROM leaf l JOIN high h ON h.row = l.row AND h.m = 1 JOIN sub s ON s.lang IS NOT DISTINCT FROM l.lang JOIN top r ON r.m = 1"""
