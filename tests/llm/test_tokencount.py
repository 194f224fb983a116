import random

from tokenizers import Tokenizer, models

from lodewell.llm import tokencount as tc


def exact(vocabulary):
    model = Tokenizer(models.Unigram([*vocabulary, ("<unk>", 0.0)], unk_id=len(vocabulary), byte_fallback=True))

    def count(text):
        return len(model.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0

    return count


def test_against_the_tokenizer(spark):
    vocabulary = tc.read_vocabulary(tc.vocabulary_path())
    counter, want = tc.UnigramCounter(vocabulary), exact(vocabulary)
    rnd = random.Random(1)
    texts = ["", "  a  b ", " ", "▁x ▁ y", "日本語 テキスト\n\n\tfoo   bar", "😀😀 a😀b", "a" * 500, "\x00\x01", " \n "]
    texts += ["".join(rnd.choice("ab e\n▁é日😀thing") for _ in range(rnd.randrange(60))) for _ in range(1000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts:
        assert counter.count(text)[0] == want(text), text[:100]


def test_ties_and_small_vocabularies():
    rnd = random.Random(3)
    for round_ in range(60):
        letters = "abc▁"
        pieces = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 5))) for _ in range(12)}
        vocabulary = [(p, float(-rnd.randrange(3))) for p in sorted(pieces)]
        if round_ % 2:
            vocabulary += [(f"<0x{b:02X}>", -2.0) for b in range(256)]
        counter, want = tc.UnigramCounter(vocabulary), exact(vocabulary)
        for _ in range(40):
            text = "".join(rnd.choice("abc d") for _ in range(rnd.randrange(1, 14)))
            assert counter.count(text)[0] == want(text), (vocabulary, text)


def test_best_score_against_all_segmentations():
    vocabulary = [("▁a", -1.0), ("▁", -2.0), ("a", -1.0), ("ab", -1.5), ("b", -1.0), ("aab", -4.0)]
    counter = tc.UnigramCounter(vocabulary)
    scores = dict(vocabulary)

    def best(text):
        return 0.0 if not text else max((scores[text[:k]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in scores), default=float("-inf"))

    for text in ("aab ab", "ab", "baab aab"):
        assert counter.count(text)[1] == best("▁" + text.replace(" ", "▁"))


def test_frames(documents, odd, clashing, empty):
    vocabulary = tc.read_vocabulary(tc.vocabulary_path())
    counter = tc.UnigramCounter(vocabulary)
    for df in (documents.limit(40), odd, clashing):
        rows = df.select("doc_id", "text").collect()
        want = sorted(((r.doc_id, len(r.text or ""), counter.count(r.text or "")[0]) for r in rows), key=str)
        assert sorted(((r.doc_id, r.n_chars, r.n_tokens) for r in tc.token_counts(df).collect()), key=str) == want
    assert tc.token_counts(empty).collect() == []
