import numpy as np

from plumbline.llm import op03_perplexity as O


def test_columns_and_keys_come_back():
    r = np.random.default_rng(1)
    for n in (0, 1, 3000):
        cols = [r.integers(0, 1 << 40, n), *(r.geometric(0.5, n) - 1 for _ in range(4))]
        assert all((a == b).all() for a, b in zip(O._uncolumns(O._columns(cols)), cols))
        for keys in (r.integers(0, 1 << 60, n).astype(np.uint64), np.zeros(n, np.uint64)):
            assert (O._unapart(O._apart(keys)) == keys).all()


def test_counts_come_back():
    r = np.random.default_rng(3)
    for x in (np.zeros(0, np.int64), np.ones(1, np.int64), np.full(9, 3), r.geometric(0.92, 8000)):
        assert (O._uncounts(O._counts(x)) == x).all()
    assert len(O._counts(x)) < 0.8 * len(O._planes(x))


def test_columns_of_rare_words_are_small():
    """Words as in a corpus, most of them rare: the columns take far less than each by itself."""
    r = np.random.default_rng(2)
    n = 3000
    n1, n2, n3 = r.geometric(0.5, n), r.geometric(0.8, n) - 1, r.geometric(0.9, n) - 1
    cols = [n1 + 2 * n2 + 3 * n3, n1, n2, n3, np.maximum(n1 + n2 + n3 - (r.random(n) < 0.1), 1)]
    keys = np.diff(np.sort(r.integers(0, 1 << 34, 8000)), prepend=0)
    alone = lambda c: sum(len(O._planes(x)) for x in c)
    assert sum(map(len, O._columns(cols))) < 0.75 * alone(cols)
    assert len(O._apart(keys.astype(np.uint64))) < 0.97 * alone([keys])
    assert len(O._add_up([O.X.fields(O._apart(keys.astype(np.uint64)), O._counts(np.full(8000, 200)))])[0]) < 200  # pairs of one chunk alone
