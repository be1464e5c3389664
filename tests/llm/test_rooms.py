"""Python workers hold little at a time, and what they hold does not change results."""

import random

import pyarrow as pa

from maskwright.llm import bin_slack, simhash


def test_ids_do_not_depend_on_what_a_worker_remembers():
    import public_tokenizers

    import corpus_pipeline

    path, draw = public_tokenizers.path("word_bpe_49k.json"), random.Random(5)
    texts = [" ".join("".join(draw.choices("abcdeé1-", k=draw.randint(1, 9))) for _ in range(200)).encode() for _ in range(60)]
    small, large = bin_slack._word_ids(path, 1 << 12, 1 << 10), bin_slack._word_ids(path, *bin_slack.ROOMS)
    for at in range(0, len(texts), 5):
        assert small(texts[at : at + 5]) == large(texts[at : at + 5])
    assert all(a < b for a, b in zip(corpus_pipeline.ROOMS, bin_slack.ROOMS))


def test_shingles_are_made_for_few_texts_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(600))], ["n"])
    parts = list(simhash._slices([batch, batch.slice(0, 0)]))
    assert [x for p in parts for x in p.column("n").to_pylist()] == list(range(600))
    assert max(p.num_rows for p in parts) == simhash.AT_ONCE


def test_parts_are_cut_as_columns_like_the_tokenizer_cuts_them():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, draw = public_tokenizers.path("word_bpe_49k.json"), random.Random(7)
    letters = "".join(map(chr, range(33, 127))) + "ÀßÿÖé" + "'''strevmld" + " \t\n\x0b\x0c\r  "
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 80))) for _ in range(2000)]
    texts += ["".join(draw.choices(letters + "×÷ªº²İΣς\x1c\x85\xa0日🙂ﬁ́", k=draw.randint(0, 80))) for _ in range(2000)]
    texts += ["", " ", " It's <|endoftext|> we'll\x0b's ", "don't!\x0b's"]
    ids = bin_slack._word_ids(path, 1 << 14, 1 << 12)
    got = [x for at in range(0, len(texts), 256) for x in ids(pa.array(texts[at : at + 256]))]
    library = Tokenizer.from_file(path)
    assert got == [b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids) for t in texts]
