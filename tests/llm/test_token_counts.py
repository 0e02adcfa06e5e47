import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from loomspan.llm import token_counts
from loomspan.llm.token_counts import PrefixCounter, longest_within, prefix_counts, tokens_of_prefix

from . import cases

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=MODEL)
COUNTER = PrefixCounter(MODEL)


def tokens(text):
    return len(LIBRARY.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abst  ▁\n\t.,'é²ü日本😀<>/0x_-"), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_every_prefix_has_the_librarys_count(texts):
    counts, first = COUNTER(texts)
    for i, t in enumerate(texts):
        assert counts[first[i] : first[i + 1]].tolist() == [tokens(t[:p]) for p in range(1, len(t) + 1)]


def test_every_prefix_of_words_and_runs():
    for t in ["the international re-organisation's unbelievable straightforwardness", "=" * 90, " " * 70 + "x", "aaaaaaaaaaaaaaaaaaaaaaaa", "<s> </s> <unk> <0x41>", "1234567890" * 9, "Donaudampfschifffahrtsgesellschaftskapitän"]:
        counts, _ = COUNTER([t])
        assert counts.tolist() == [tokens(t[:p]) for p in range(1, len(t) + 1)]


def test_what_is_kept_changes_nothing(monkeypatch):
    texts = [r[1] or "" for r in cases.documents()][:60]
    want = COUNTER(texts)[0].tolist()
    for name in ("_SEGMENTS", "_CHARS", "_PAIRS"):
        monkeypatch.setattr(token_counts, name, 3)
    small = PrefixCounter(MODEL)
    assert [c for i in range(0, 60, 7) for c in small(texts[i : i + 7])[0].tolist()] == want


def test_counts_of_documents(spark):
    rows = [*cases.documents(), (None, "a row without an id", None, None, 0, 7, "x", "y", 1, 2)]
    got = sorted(map(tuple, prefix_counts(cases.frame(spark, rows), MODEL, limit=50).collect()), key=str)
    fit = lambda t: max((p for p in range(len(t) + 1) if tokens(t[:p]) <= 50), default=0) if len(t) < 900 else None
    want = sorted(((r[0], len((t := r[1] or "").encode()), tokens(t), tokens(t) > 50, fit(t)) for r in rows), key=str)
    assert len(got) == len(want) and all(a[:4] == b[:4] and b[4] in (None, a[4]) for a, b in zip(got, want))
    assert prefix_counts(cases.frame(spark, []), MODEL).count() == 0


def test_stored_counts_answer_questions_without_encoding(spark):
    texts = {0: "", 1: None, 2: "Some words that are counted, 日本 😀 and more", 3: "x" * 500}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    stored = prefix_counts(docs, MODEL, limit=7, with_counts=True)
    asked = stored.select("doc_id", "counts", "fit_chars", longest_within(7).alias("fit"), longest_within(F.col("doc_id") * 3).alias("own"), tokens_of_prefix(10).alias("ten"), tokens_of_prefix(0).alias("none"), tokens_of_prefix(9999).alias("all"), "n_tokens")
    for r in asked.collect():
        t = texts[r["doc_id"]] or ""
        assert r["counts"] == [tokens(t[:p]) for p in range(1, len(t) + 1)]
        fit = lambda n: max(p for p in range(len(t) + 1) if tokens(t[:p]) <= n)  # noqa: B023,E731
        assert r["fit"] == r["fit_chars"] == fit(7) and r["own"] == fit(3 * r["doc_id"])
        assert r["ten"] == tokens(t[:10]) and r["none"] == 0 and r["all"] == r["n_tokens"] == tokens(t)


def test_a_model_that_changes_texts_is_refused(monkeypatch, tmp_path):
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    model = ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    for change in (lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.trainer_spec, "model_type", 1), lambda m: m.pieces.add(piece="ab▁c", score=-1.0)):
        other = ModelProto()
        other.CopyFrom(model)
        change(other)
        (tmp_path / "m.model").write_bytes(other.SerializeToString())
        with pytest.raises(ValueError):
            PrefixCounter(str(tmp_path / "m.model"))
