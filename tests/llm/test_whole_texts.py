"""The corpus operators do the whole job: cases that an earlier version left out."""

import random
import re
import textwrap

from velum.llm import op3_licenses, op8_pii, op10_classifier


def test_cut_weighs_good_against_bad(spark):
    r = random.Random(5)
    rows = [(True, True, 1 + r.random()) for _ in range(500)] + [(True, True, -0.9)] * 2 + [(False, True, -0.8 + 0.5 * r.random()) for _ in range(300)]
    rows += [(True, False, -5.0), (None, True, -5.0)]
    at, good, bad = op10_classifier.cut(spark.createDataFrame(rows, "good boolean, held boolean, per_ngram double"))
    assert at >= 1 and good >= 0.98 and bad == 0.0
    only_good = spark.createDataFrame(rows[:502], "good boolean, held boolean, per_ngram double")
    assert op10_classifier.cut(only_good) == (-0.9, 1.0, None)
    assert op10_classifier.cut(only_good.where("NOT good")) is None


SECRETS = {
    "token = " + "a1B2" * 100: "a1B2" * 100, '{"api_key": "0123456789abcdefXYZ"}': "0123456789abcdefXYZ", "{'password': 'hunter2'}": "hunter2",
    "passwd: s3cr#t!x,": "s3cr#t!x", "password=abcdef": "abcdef", "secret: ab12cd34 x": "ab12cd34",
}
DATES = ["3/7/1999", "03.07.1999", "3-7-1999", "31.12.2001", "12/31/2001", "1999-7-3", "1999/07/03", "1999.7.3"]
STAY = ["token: something", "the secret: 1234567", "31.2.1999", "32/1/1999", "v 1.2.3.1999", "3/7-1999", "1999-13-01", "13/13/2001"]


def test_secrets_and_dates_of_all_forms(spark):
    texts = [*SECRETS, *(f"on {d}." for d in DATES), *STAY]
    out = {r.doc_id: r for r in op8_pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), op8_pii.DEMO_KEY).collect()}
    for k, (text, value) in enumerate(SECRETS.items()):
        (p,) = out[k].pii
        new = out[k].text[p.start : p.start + p.length]
        assert p.kind == "secret" and p.length == len(value) and new != value and out[k].text.replace(new, value) == text, text
    for k, d in enumerate(DATES, len(SECRETS)):
        (p,) = out[k].pii
        new = out[k].text[p.start : p.start + p.length]
        assert p.kind == "date" and new != d and re.sub(r"\d+", "", new) == re.sub(r"\d+", "", d) and out[k].text == f"on {new}.", d
    for k, text in enumerate(STAY, len(SECRETS) + len(DATES)):
        assert out[k].text == text and not out[k].pii, text


def test_wrapped_notices_are_found(spark):
    rows = [(k, width, label, "some words before\n\n" + "\n".join("# " + x for x in textwrap.wrap(notice, width)) + "\n\nand after it") for k, (label, notice) in enumerate(op3_licenses.TEMPLATES) for width in (20, 40, 79)]
    rows.append((99, 0, "", "redistribution and use\nin source\n" + "filler " * 100 + "\nand binary forms with or without modification are permitted provided that"))
    df = spark.createDataFrame(rows, "k long, width long, label string, text string")
    for x in op3_licenses.scan(df, keep=("k", "width", "label", "text")).collect():
        if x.label:
            assert x.label in x.labels.split(",") and x.score == 1.0, x.text
            assert any(m.template == x.k and m.containment == 1.0 for m in x.matches), x.text
        else:
            assert x.labels == "" and x.score == 0.0
