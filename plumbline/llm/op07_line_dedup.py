"""Operator 7, fuzzy line dedup by MinHash, in DataFrame functions only.

A line's set is its character shingles, with ``every`` the ``width`` characters from each position (the whole line if it has
fewer). Without it, they are fewer: at each word start the next ``width`` characters (fewer at the end), and in
a word longer than that each run of ``width`` characters of it, so that every character is in a shingle. They are
32-bit hashes; chance meetings of two such bands are thrown out by the verification.
1. Equal lines collapse to their first occurrence (least document, then line number).
2. The signature of a line is the ``bands`` smallest hashes of its shingles, and each two of them are a band
   (a line of one shingle has one). Two lines whose sets overlap by a share J miss each other only if at most one of
   their union's smallest ``bands`` lies in the overlap: 1.6 % at J = 0.75 and five, 0.7 % at 0.8.
3. The lines of a band with sets of like size are paired with four lines of it, so m lines give pairs in
   proportion to m, not to m * m.
4. Pairs are verified with the exact Jaccard of their whole sets (100 * intersection >= threshold * union) and united.
5. Lines of a larger band that are still in different components meet exactly (``_crowd_pairs``), so that all near
   pairs with a common band are joined. Its work grows with the lines outside the main component of the
   group of a rare shingle times all lines of that group.
6. The first occurrence in each component stays and all its others go.

Lines of white space alone are no lines: they stay. Null texts have no lines. A document whose lines all go
keeps its row with an empty text. Rows that share an id count as one document: a line number that goes, goes from each
of them. Rows with a null id keep all their lines. Extra columns stay, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.components import components
from plumbline.operators.store import written

from .store import fresh


def _pattern(width: int) -> str:
    return rf"(?s)(?=([^ \t].{{0,{width - 1}}}))(?:[^ \t](?=[^ \t]{{{width}}})|[^ \t]+)"


def _shingles(width: int, every: bool) -> str:
    if every:  # characters of four bytes are found without a walk from the line's start
        starts = f"sequence(0, greatest(0, cast(octet_length(u) div 4 as int) - {width}))"
        return f"transform(array(encode(line, 'UTF-32')), u -> transform({starts}, i -> hash(substr(u, 4 * i + 1, {4 * width}))))[0]"
    return rf"transform(regexp_extract_all(line, '{_pattern(width)}', 1), x -> hash(x))".replace("\\t", "\\\\t")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line) of every line with a character that isn't white space."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.split(F.col(text_col).cast("string"), "\n").alias("t"))
    return src.select("doc_id", F.posexplode("t").alias("line_no", "line")).where(F.btrim("line", F.lit(" \t\r\f\x0b")) != "")


def _near(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are near."""
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "s": "x"}), "a").join(sets.withColumnsRenamed({"id": "b", "s": "y"}), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= threshold * (F.size("x") + F.size("y") - common)).select(*pairs.columns)


def _crowd_pairs(crowd: DataFrame, sets: DataFrame, threshold: int, block: int = 512) -> DataFrame | None:
    """(a, b, p, q): of the lines of bands with several components (label), every pair from two of them, p and q,
    that can be near; None if there are no such lines.

    Near sets share one of their rarest shingles (a prefix filter, by any fixed order). In each such group the lines outside
    its largest component meet all others, ``block`` by ``block``. Pairs are left out by bounds only: of the sizes, of
    what follows the shared shingle, and of the bits in which the parities of 256 classes of shingles differ.
    """
    band = ["b", "c", "z"]
    mixed = crowd.groupBy(band).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(band)
    parity = [F.expr(f"aggregate(s, 0L, (v, x) -> if(pmod(shiftright(x, 6), 4) = {k}, v ^ shiftleft(1L, x & 63), v))").alias(f"s{k}") for k in range(4)]
    lines = written(crowd.join(mixed, band, "left_semi").select("id", "label").distinct().join(sets, "id").select("id", "label", F.size("s").alias("n"), "s", *parity))
    if lines.isEmpty():
        return None
    word = lines.select("id", F.explode("s").alias("t"))
    often = word.groupBy("t").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    order = word.join(often, "t", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "t"))).alias("v"))
    rare = lines.drop("s").join(order, "id").withColumn("v", F.expr(f"slice(v, 1, n - (({threshold} * n + 99) div 100) + 1)"))
    rare = written(rare.select("id", "label", "n", "s0", "s1", "s2", "s3", F.posexplode("v").alias("i", "v")).where("v.f > 1").select("*", "v.t").drop("v"))
    share = rare.groupBy("t", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("t").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("m"), F.max("k").alias("top")).where("m > top")
    cells = F.expr(f"cast(ceil((m - top) / {block}) as int)"), F.expr(f"cast(ceil(m / {block}) as int)")
    placed = rare.join(share, "t").withColumns({"across": cells[0], "down": cells[1]}).drop("m", "top")
    x = placed.where("label <> main").select("*", F.expr("pmod(id, across)").alias("u"), F.explode(F.expr("sequence(0, down - 1)")).alias("w")).alias("x")
    y = placed.select("*", F.expr("pmod(id, down)").alias("w"), F.explode(F.expr("sequence(0, across - 1)")).alias("u")).alias("y")
    differ = " + ".join(f"bit_count(x.s{k} ^ y.s{k})" for k in range(4))
    met = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.u") == F.col("y.u")) & (F.col("x.w") == F.col("y.w")) & F.expr(f"""x.label <> y.label and (y.label = y.main or x.id < y.id)
        and 100 * least(x.n, y.n) >= {threshold} * greatest(x.n, y.n) and {100 + threshold} * (least(x.n - x.i, y.n - y.i)) >= {threshold} * (x.n + y.n)
        and {100 + threshold} * ({differ}) <= {100 - threshold} * (x.n + y.n)"""))
    return written(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.label").alias("p"), F.col("y.label").alias("q")).distinct())


def near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 24, bands: int = 5, threshold: int = 75, every: bool = False) -> DataFrame:
    """(doc_id, line_no, keep_doc, keep_line) of every line that repeats an earlier one, exactly or nearly."""
    lines = lines_of(docs, id_col, text_col)
    two = [F.xxhash64("line").alias("h"), F.hash("line").alias("g")]
    at = F.struct("doc_id", "line_no").alias("at")
    sets = lines.select(*two, at, F.expr(f"array_distinct({_shingles(width, every)})").alias("a"))
    sig = F.struct(F.size("a").alias("size"), F.expr(f"slice(sort_array(a), 1, {bands})").alias("low")).alias("sig")
    first = sets.select("h", "g", "at", sig).groupBy("h", "g").agg(F.min("at").alias("at"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n"))
    first = written(first.select(F.xxhash64("at.doc_id", "at.line_no").alias("id"), "h", "g", "at", "sig.size", "sig.low", "n"))
    # what shares a band with nothing leaves
    band = first.select(F.explode("low").alias("b"), "id", "size")
    shared = band.groupBy("b").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    held = written(band.join(shared, "b", "left_semi"))
    # lines that share two bands form stars around four of them; size classes keep apart what can't be near
    two_bands = held.join(held.select(F.col("b").alias("c"), "id"), "id").where("b < c").select("b", "c", "id", "size")
    z = F.floor(F.log("size") / math.log(100 / threshold) + 1e-9)
    one_band = held.where("size = 1").select("b", F.lit(0).cast("int").alias("c"), "id", "size")
    keyed = one_band.unionAll(two_bands).withColumn("z", F.explode(F.array(z, z + 1)))
    by_id, by_hash = F.struct(F.col("id").alias("o"), "id", "size"), F.struct(F.xxhash64("id", "b").alias("o"), "id", "size")
    heads = written(keyed.groupBy("b", "c", "z").agg(F.count(F.lit(1)).alias("m"), F.array_distinct(F.array(F.min(by_id), F.max(by_id), F.min(by_hash), F.max(by_hash))).alias("heads")).where("m > 1"))
    star = keyed.join(heads, ["b", "c", "z"]).select("id", "size", F.explode("heads").alias("head"))
    star = star.where(f"id <> head.id and 100 * least(size, head.size) >= {threshold} * greatest(size, head.size)")
    pairs = written(star.select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b")).distinct())
    # lines of bands where not all pairs have a head
    crowd = written(keyed.join(heads.where("m > size(heads) + 1").select("b", "c", "z"), ["b", "c", "z"], "left_semi").select("b", "c", "z", "id"))
    # whole sets of the lines in pairs and crowds only
    need = written(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).unionAll(crowd.select("id")).distinct())
    own = lines.select(F.xxhash64("doc_id", "line_no").alias("id"), "line").join(need, "id", "left_semi")
    sets = written(own.select("id", F.expr(f"array_distinct({_shingles(width, every)})").alias("s")).dropDuplicates(["id"]))
    comp = components(_near(pairs, sets, threshold).select("a", "b"))
    label = lambda df, c, key: df.join(c.withColumnsRenamed({"node": key, "label": "l_"}), key, "left").withColumn("label", F.coalesce("l_", key)).drop("l_")
    named = label(first.select("id", "h", "g", "n", "at"), comp, "id")
    rest = _crowd_pairs(label(crowd, comp, "id"), sets, threshold)
    if rest is not None:  # components of components
        joined = components(_near(rest, sets, threshold), "p", "q")
        named = label(named.withColumnRenamed("label", "part"), joined, "part")
    # the earliest line of each component, for those with more than one occurrence
    keep = named.groupBy("label").agg(F.min("at").alias("keep"), F.sum("n").alias("total")).where("total > 1")
    drop = named.join(keep, "label").select("h", "g", "keep")
    gone = lines.select(*two, at).join(drop, ["h", "g"]).where("at <> keep")
    return gone.select("at.doc_id", "at.line_no", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.line_no").alias("keep_line"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without their repeated lines; all other columns as they are."""
    id_, gone_ = fresh("id"), fresh("gone")
    gone = near_lines(docs, id_col, text_col, **options).groupBy(F.col("doc_id").alias(id_)).agg(F.collect_set("line_no").alias(gone_))
    out = docs.join(gone, F.col(id_col).cast("long") == F.col(id_), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col(gone_), i)), "\n")
    return out.select(*(F.when(F.col(gone_).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
