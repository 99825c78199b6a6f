"""Registered queries work on whole documents and return their whole result."""

import unicodedata

from velum.plans import catalog


def _write(spark, where, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{where}/documents.parquet")


def _folded(text):
    out = []
    for c in text:
        low = unicodedata.normalize("NFD", c.lower())[:1]
        out.append(low if low.isascii() and low.isalnum() else c)
    return "".join(out)


def test_fold_text_folds_the_whole_text(spark, tmp_path):
    texts = ["É" * 499 + "ÇÃO" + " Fim À noite" * 200, "", "curto Ñ"]
    _write(spark, tmp_path, texts)
    got = {r.doc_id: r.folded for r in catalog.QUERIES["fold_text"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(map(_folded, texts)))


def test_find_returns_every_entity_and_pattern(spark, tmp_path):
    _write(spark, tmp_path, ["cartao amex 378282246310005 e cartao 4111111111111111", "x " * 300 + "CPF 529.982.247-25, CEP 22290-040", "nada"])
    cards = {r.doc_id: r.n for r in catalog.QUERIES["find_card_documents"](spark, str(tmp_path)).collect()}
    assert cards == {0: 2}
    found = {(r.doc_id, r.entity, r.value) for r in catalog.QUERIES["find_documents"](spark, str(tmp_path)).collect()}
    assert found == {(0, "BR_CARTAO", "378282246310005"), (0, "BR_CARTAO", "4111111111111111"), (1, "BR_CPF", "529.982.247-25"), (1, "BR_CEP", "22290-040")}
