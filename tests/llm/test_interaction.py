from itertools import permutations

import pytest

from wavelake.llm.interaction import FILTERS, audit

from .conftest import WORD

KEYS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def brute(docs, labels):
    """(part, order, step) -> counts, document by document."""
    good, toxic = ({i for i, q, t in labels if i is not None and v(q, t)} for v in (lambda q, t: q == 1, lambda q, t: t == 1))
    fails = []
    for i, text, source in docs:
        t = text or ""
        ws, failed = WORD.findall(t), set()
        if len(ws) < 50:
            failed.add("A")
        if 100 * len(set(ws)) < 65 * len(ws):
            failed.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            failed.add("C")
        if set(t) & set("#$%&*|"):
            failed.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            failed.add("E")
        fails.append((source or "", i, failed))
    out = {}
    for part in {p for p, _, _ in fails}:
        total = dict.fromkeys(FILTERS, 0)
        for order in map("".join, permutations(FILTERS)):
            for step, f in enumerate(order, 1):
                row = dict.fromkeys(KEYS, 0)
                for p, i, failed in fails:
                    if p != part:
                        continue
                    earlier = bool(failed & set(order[: step - 1]))
                    removed = f in failed and not earlier
                    row["kept"] += not failed & set(order[:step])
                    row["removed"] += removed
                    row["redundant"] += f in failed and earlier
                    row["unique_fails"] += failed == {f}
                    row["good_lost"] += removed and i in good
                    row["toxic_lost"] += removed and i in toxic
                total[f] += row["removed"]
                out[part, order, step] = row
        for (p, order, step), row in out.items():
            if p == part:
                row["shapley"] = total[order[step - 1]]
    return out


def check(spark, docs, labels):
    got = audit(docs, labels).collect()
    found = {(r.part, r.filter_order, r.step): {k: r[k] for k in (*KEYS, "shapley")} for r in got}
    assert len(found) == len(got)
    rows = lambda d, *c: [tuple(r) for r in d.select(*c).collect()]
    assert found == brute(rows(docs, "doc_id", "text", "source"), rows(labels, "doc_id", "quality", "toxic"))
    return found


def test_against_brute_force(spark):
    good = " ".join(f"w{i}" for i in range(60))
    texts = [good, good, good.upper(), good + " #", "a b c", "a b c", "", None, "x " * 100, "X$ " * 100, good + " tail", good]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, len(texts), 1)], "doc_id long, quality int, toxic int")
    found = check(spark, docs, labels)
    assert len(found) == 2 * 600
    assert found["a", "EABCD", 1]["removed"] == 0 and found["b", "EABCD", 1]["removed"] == 4


def test_odd_rows(spark, odd):
    """Nulls, repeated rows, doc_ids and labels, clashing names and a long text."""
    docs = odd.selectExpr("*", "1 as part", "2 as step", "3 as kept", "4 as failed", "'x' as filter_order", "true as good")
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1), (7, None, 1), (7, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    found = check(spark, docs, labels)
    assert {k[0] for k in found} == {"", "a", "b"}
    check(spark, docs, labels.limit(0))


def test_copies_of_one_text(spark):
    """A third of all rows share a text: one is the original."""
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', concat('t', id)) as text", "'s' as source")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    row = audit(docs, labels).where("filter_order = 'EABCD' and step = 1").first()
    assert (row.removed, row.kept, row.part) == (999, 2001, "s")


@pytest.mark.parametrize("source", [None, ""])
def test_null_source_is_the_empty_string(spark, source):
    docs = spark.createDataFrame([(1, "a", source), (2, "b", None), (3, "c", "")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = audit(docs, labels)
    assert out.count() == 600 and out.where("step = 1 and filter_order like 'A%'").agg({"removed": "max"}).first()[0] == 3


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
