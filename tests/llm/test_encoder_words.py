"""Words of ASCII texts, and how many words a packing worker remembers."""

import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tidewire.llm import entry, packing

ODD = ["", " ", "it's 'tis we'll 'd' 's's", "a  b   c \n\n d\t\te ", "x1y22 333abc!!?? --- $5.00\x1c\x1d\x1e\x1f\x00\x7f", "\r\n end  \x0b\x0c", "'re've'm'S'T", "  \n  !a _b_ <|endoftext|> c", "'", " 's", "naïve café 's"]


def test_ascii_pattern_splits_alike():
    assert all(re.findall(packing.ASCII_PATTERN, t) == re.findall(packing.PATTERN, t) for t in ODD if t.isascii())


def test_known_and_new_words_give_the_ids_of_the_library():
    made = packing.Encoder(entry.tokenizer_path(), remembered=20)
    for texts in (ODD, ODD[::-1], ODD[2:5] + ["quite new words"] + ODD[2:5]):
        wanted = [made.exact.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.asarray(ids).tolist() for ids in made.encode(texts)] == wanted


def test_pipeline_workers_remember_fewer_words(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(packing, "pack", lambda docs, path, **given: seen.append(given) or docs)
    monkeypatch.setattr(packing, "digest", lambda pieces: pieces)
    corpus_pipeline.pack_sequences(spark, None, "")
    assert seen == [{"remembered": corpus_pipeline.REMEMBERED}] and corpus_pipeline.REMEMBERED < packing.REMEMBERED


def test_lean_packing_splits_few_texts_at_a_time_and_forgets(monkeypatch):
    texts = [f"text {k} of common words, it's {k * 7} long" if k % 5 else None for k in range(250)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(250), pa.int64()), "text": pa.array(texts, pa.string())})
    path, many = entry.tokenizer_path(), []
    encode = packing.Encoder.encode
    monkeypatch.setattr(packing.Encoder, "encode", lambda self, texts: many.append(len(texts)) or encode(self, texts))
    few, usual = (pa.Table.from_batches(list(packing.packer(path, remembered=n)([batch]))) for n in (corpus_pipeline.REMEMBERED, packing.REMEMBERED))
    assert few.equals(usual)
    assert many == [100, 100, 50, 250]
    assert not packing.encoder(path, corpus_pipeline.REMEMBERED).known and packing.encoder(path).known


def test_wide_pattern_splits_alike():
    assert all(re.findall(packing.WORD_PATTERN, t) == re.findall(packing.PATTERN, t) for t in [*ODD, "É’été ñ ǅ's ²³\xa0\xa0x \x85 …€ 12é"])


def test_words_of_several_batches_are_kept_when_room_is_made():
    made = packing.Encoder(entry.tokenizer_path(), remembered=60)
    learned = []
    learn = made._learn
    made._learn = lambda words: learned.append(set(words)) or learn(words)
    for k in range(12):
        texts = ["the common words occur always " + " ".join(f"w{chr(97 + k)}{chr(97 + n)}" for n in range(8))]
        assert [ids.tolist() for ids in made.encode(texts)] == [made.exact.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(made.known) <= 60
    assert sum(" always" in words for words in learned) == 1
    made.forget()
    assert not made.known and not made.again


def test_every_byte_of_a_word_is_encoded():
    made = packing.Encoder(entry.tokenizer_path())
    texts = ["".join(map(chr, range(0x250))), *(f"x{chr(c)} {chr(c)}{chr(c)}" for c in range(0x250)), "\n", "\n\n\n a"]
    wanted = [made.exact.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in made.encode(texts)] == wanted
    assert all(made._split(t) is not None for t in texts)
