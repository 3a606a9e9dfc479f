import hashlib
import random
import zlib

import pytest

from gleanset.llm.manifest import audit, manifest
from tests.llm import cases

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, **changed):
    values = [changed.get(f, row[f]) for f in FIELDS]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """Levels of one list of nodes and what stands in each run."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([digest(*low[i:i + 8]) for i in range(0, len(low), 8)])
    return levels


def steps(levels, at):
    out = []
    for low in levels[:-1]:
        first = at // 8 * 8
        out.append(("".join(low[first:at]), "".join(low[at + 1:first + 8])))
        at //= 8
    return out


def by_hand(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for rows_ in groups.values():
        rows_.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {g: climb([leaf(r) for r in groups[g]]) for g in order}
    upper = climb([trees[g][-1][0] for g in order])
    root, out = upper[-1][0], []
    for number, g in enumerate(order):
        for at, row in enumerate(groups[g]):
            path = steps(trees[g], at) + steps(upper, number)
            node, text = leaf(row), row["text"]
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and text is not None:
                node = leaf(row, text="".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            for left, right in path:
                node = digest(left, node, right)
            out.append((row["doc_id"], leaf(row), trees[g][-1][0], root, digest(*[a + b for a, b in path]), node, node == root))
    return sorted(out, key=str)


def check(frame):
    got = sorted((tuple(r) for r in audit(manifest(frame)).collect()), key=str)
    expected = by_hand([r.asDict() for r in frame.collect()])
    assert got == expected
    return got


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 9}, {"de": 64, "en": 65, "é": 1, "": 3, "z": 130}])
def test_shapes(spark, sizes):
    rows = [(i * 7 % 1009, f"Text {lang} {i}", lang, f"s{i % 3}", i, "x") for lang, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    got = check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, group string"))
    if len(rows) > 9:
        assert {r[-1] for r in got} == {True, False}


def test_many_groups(spark):
    """More groups than one run: the tree over subroots has levels, too."""
    rows = [(i, f"Text {i}", f"l{i % 83}", None, i) for i in range(170)]
    check(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, n_chars long"))


def test_awkward_documents(spark):
    check(cases.documents(spark))


def test_repeated_rows(spark):
    """Most rows are one row many times over; equal leaves share their siblings within a run."""
    rows = [(5, "Same Text", "en", "a", 9)] * 100 + [(i, f"Other {i}", "en", "b", 1) for i in range(20)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_only_tampered_rows_fail(spark):
    rows = audit(manifest(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))).collect()
    for row in rows:
        assert row["verified"] or zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
    assert len({r["root"] for r in rows}) == 1 and not all(r["verified"] for r in rows)


def test_empty_table(spark):
    assert audit(manifest(cases.empty(spark))).count() == 0
