"""What a stage costs: rows measured once, and findings at a price that doesn't grow with their number in a text."""

import time

import numpy as np
from pyspark.sql import functions as F

from velum.llm import op5_simhash, op6_rules, op8_pii


def _seconds(df):
    began = time.time()
    return df.collect(), time.time() - began


def test_rules_read_their_counts(spark):
    text = lambda k: " ".join(f"plain{chr(97 + i % 26)}{chr(97 + (i + k) % 26)}{chr(97 + i // 26)}" for i in range(60))
    good = [(i, text(i), "a") for i in range(20)]
    docs = spark.createDataFrame([*good, (20, "one two three four five " * 20, "b"), (21, None, "c"), (1, "short", "d")], "doc_id long, text string, source string")
    kept = op6_rules.kept_documents(docs)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "regexp" not in plan  # the texts are measured before, not again for the verdict
    assert sorted(tuple(r) for r in kept.collect()) == good


def test_windows_are_those_of_five_words(spark):
    texts = {"a b c d": 0, "a b c d e": 0, "a a a a a a": 6, "a b c d e x a b c d e": 10, "a b c d e a b c d": 0}
    rows = op6_rules.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("row.doc_id", "m.n_repeat_words", "m.word_chars").collect()
    assert {r.doc_id: r.n_repeat_words for r in rows} == dict(enumerate(texts.values()))
    assert {r.doc_id: r.word_chars for r in rows} == {i: len(t.replace(" ", "")) for i, t in enumerate(texts)}


def test_many_findings_in_one_text(spark):
    n, line = 20_000, "at 10.20.30.44 or 999.1.1.1\n"
    _, apart = _seconds(op8_pii.pseudonymise(spark.createDataFrame([(i, line * 100) for i in range(n // 100)], "doc_id long, text string").coalesce(1), op8_pii.DEMO_KEY))
    (row,), together = _seconds(op8_pii.pseudonymise(spark.createDataFrame([(1, line * n)], "doc_id long, text string"), op8_pii.DEMO_KEY))
    found = {row.text[s.start : s.start + s.length] for s in row.pii}
    assert len(row.pii) == n and len(found) == 1 and found != {"10.20.30.44"}
    assert row.text == line.replace("10.20.30.44", found.pop()) * n
    assert together < 5 * apart + 5


def test_cards_cost_little_more_than_other_numbers(spark):
    def made(value):
        docs = spark.range(0, 8_000, 1, 4).select(F.col("id").alias("doc_id"), F.repeat(F.lit(value + " ; "), 3).alias("text"))
        return _seconds(op8_pii.pseudonymise(docs, op8_pii.DEMO_KEY).select("text", F.size("pii").alias("n")))

    rows, numbers = made("123-45-6789")
    assert all(r.n == 3 for r in rows)
    rows, cards = made("4111 1111 1111 1111")
    assert all(r.n == 3 for r in rows) and len({r.text for r in rows}) == 1
    card = [int(c) for c in rows[0].text.split(" ; ")[0] if c != " "]
    assert card[:6] == [4, 1, 1, 1, 1, 1] and sum(2 * d - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(card)) % 10 == 0
    assert cards < 4 * numbers


def test_nodes_travel_once_to_each_outer_list(spark, monkeypatch):
    monkeypatch.setattr(op5_simhash, "LIST_ROWS", 240)
    r, n = np.random.default_rng(4), 3_000
    fp = r.integers(0, 1 << 64, (n, 4), dtype=np.uint64)
    for i in range(0, n, 3):  # near pairs, and a group with more candidates than the limit
        fp[i + 1] = (fp[i] if i > 60 else fp[0]) ^ (np.uint64(1) << r.integers(0, 64, 4, dtype=np.uint64))
    sig = r.integers(0, 1 << 64, (n, 2), dtype=np.uint64)
    node = np.concatenate([sig, fp, np.full((n, 1), 200, np.uint64)], axis=1)
    nodes = spark.createDataFrame([(bytearray(a.tobytes()), bytearray(b.tobytes()), 200) for a, b in zip(sig, fp)], "sig binary, fp binary, n_shingles long").repartition(3).cache()
    filters = op5_simhash.Filters(n)
    lists, rows = filters.lists(fp)
    by = np.argsort(lists, kind="stable")
    pairs, more = set(), set()
    for of in np.split(rows[by], np.flatnonzero(np.diff(lists[by])) + 1):
        left, right, cut = op5_simhash.candidates(node[of], None, op5_simhash.LIMIT)
        pairs |= {frozenset((sig[i].tobytes(), sig[j].tobytes())) for i, j in zip(of[left], of[right])}
        more |= {sig[i].tobytes() for i in of[cut]}
    sent, frame, whole = [], type(nodes), type(nodes).repartition

    def repartition(df, *a):
        sent.append(df)
        return whole(df, *a)

    def sure(pairs, more):  # which of equally near ones stay of a node with too many is left to their order
        return {p for p in pairs if not p <= more}, more

    def found():
        monkeypatch.setattr(frame, "repartition", repartition)
        out = op5_simhash._search(nodes, filters, {}).collect()
        monkeypatch.setattr(frame, "repartition", whole)
        return {frozenset((bytes(x.a), bytes(x.b))) for x in out if x.b}, {bytes(x.a) for x in out if x.b is None}

    assert not filters.one and len(pairs) > 900 and len(more) > 10
    assert sure(*found()) == sure(pairs, more)
    assert sent[0].count() == len(set(zip((lists // filters.inner).tolist(), rows.tolist()))) < 0.75 * len(lists)
    filters.groups = 3
    assert sure(*found()) == sure(pairs, more)
    filters.outer_rows = 60  # lists longer than a task holds: what is torn goes on to the second pass
    torn, on = found()
    assert len(torn & pairs) < len(pairs) and all(p <= on for p in pairs - torn if not p <= more) and more <= on
