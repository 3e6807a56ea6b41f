"""How rows move, and what is encoded once."""

from pyspark.sql import functions as F

from sparkloom.llm import tokens as T
from sparkloom.llm.line_dedup import dedup_lines


def test_texts_meet_their_lost_lines_by_sorting_at_any_size(spark):
    line = "a line of more than forty code points that comes often"
    docs = spark.range(8).select(F.col("id").alias("doc_id"), F.concat(F.lit(line + "\n"), F.col("id").cast("string")).alias("text"))
    out = dedup_lines(docs, with_text=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    assert sorted(r["n_dropped"] for r in out.collect()) == [0] + [1] * 7


def test_words_with_signs_are_put_together_and_not_kept():
    enc = T.WordEncoder(T.tokenizer_path())
    text = "Hello, hello. it's don't!' AB's _a_ a_ (b) <|endoftext|>. x<| ''s 9a. a9. été. Été!?"
    want = enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert list(T.as_ids(enc.encode(text.encode()))) == want == list(T.as_ids(enc.encode(text.encode())))
    assert b"hello" in enc and b"hello." not in enc


def test_signs_and_capitals_make_no_word_that_is_not_in_the_memory():
    missed = []

    class Counted(T.WordEncoder):
        def __missing__(self, word):
            missed.append(word)
            return super().__missing__(word)

    enc = Counted(T.tokenizer_path())
    enc.encode(b"hello world , ###")
    missed.clear()
    text = "Hello, WORLD### world, hello hello###"
    assert list(T.as_ids(enc.encode(text.encode()))) == enc.tokenizer.encode(text, add_special_tokens=False).ids and not missed
    for odd in ("İ. İ, Å. á, É's, 'S. x'LL, é…, a…. ,a, \x01a. <|ENDOFTEXT|>, A", "K's ſ. ŉ, o'S' (A) 中A, A中."):
        assert list(T.as_ids(enc.encode(odd.encode()))) == enc.tokenizer.encode(odd, add_special_tokens=False).ids


def test_a_turn_of_the_memory_keeps_what_is_in_use(monkeypatch):
    monkeypatch.setattr(T, "CACHE_BYTES", 4_000)
    kept = T.Memory()
    for i in range(200):
        kept.keep(b"word%d" % i, b"ids.")
        assert kept.get(b"often") or kept.recall(b"often") or (i == 0 and kept.keep(b"often", b"ids."))
    assert len(kept) + len(kept.old) < 30
