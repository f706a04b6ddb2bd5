"""Packing, counts, shards and pieces against the libraries, and exact round trips."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import HARD_TEXTS  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, merge_dropout, packing, token_counts, training_order

ALPHABET = "ab é中 \n\t.,'<|>0 end▁\x1c"


@pytest.fixture(scope="module")
def library(byte_bpe):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(byte_bpe)


@pytest.fixture(scope="module")
def pieces(piece_bpe):
    return merge_dropout.Vocabulary(piece_bpe)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=60), min_size=1, max_size=6))
def test_ids_are_the_librarys(library, byte_bpe, texts):
    texts = [*texts, "x <|endoftext|> y<|endoftext|>", *texts]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = bpe.worker_copy(byte_bpe)
    n, ids = encoder.ids(pa.array(texts, pa.large_string()))
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert encoder.counts(pa.array(texts, pa.large_string())).tolist() == n.tolist()


def test_ids_of_every_character(library, byte_bpe):
    chars = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    texts = ["".join(f"a{c}b {c}c d{c} {c} " for c in chars[i : i + 4096]) for i in range(0, len(chars), 4096)]
    encoder = bpe.worker_copy(byte_bpe)
    for t in texts:
        assert encoder.ids(pa.array([t], pa.large_string()))[1].tolist() == library.encode(t, add_special_tokens=False).ids


def test_ids_of_long_texts_by_windows(library, byte_bpe):
    encoder = bpe.Encoder(byte_bpe, window=64)
    for t in ("word gap  end. " * 60, "x" * 500, " lead" * 100, "é中 " * 90, "a <|endoftext|>b " * 30, "it's we'll 12 " * 40):
        n, ids = encoder.ids(pa.array([t], pa.large_string()))
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids and n.tolist() == [len(ids)]


def test_table_is_emptied_when_full(byte_bpe, library):
    small = bpe.Encoder(byte_bpe, slots=16)
    for t in ["a b c d e f g", "a z", "g f e", "h i j k l m n o p q r s t u v w x"[:19], "a b c d e f g"] * 3:
        assert small.ids(pa.array([t], pa.large_string()))[1].tolist() == library.encode(t, add_special_tokens=False).ids


def test_counts(spark, hard, no_documents, library, byte_bpe, piece_bpe):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(hard, byte_bpe).collect())
    want = []
    for r in hard.collect():
        t = r["text"] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        want.append((r["doc_id"] if r["doc_id"] is not None else -1, len(t.encode()), n, n > 1024))
    assert got == sorted(want)
    assert token_counts.token_counts(no_documents, byte_bpe).count() == 0
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=piece_bpe)
    assert sorted(r["n_tokens"] for r in token_counts.token_counts(hard, piece_bpe).collect()) == sorted(len(sp.encode(r["text"] or "")) for r in hard.collect())


def test_packing(spark, hard, no_documents, library, byte_bpe):
    rows = packing.pack(spark, hard.repartition(3), byte_bpe, length=64).collect()
    at = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == r["length"] and r["offset"] + r["length"] <= 64
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s, pieces in at.items():
        assert [o for o, _ in sorted(pieces)] == [0, *np.cumsum([n for _, n in sorted(pieces)])[:-1]]
        assert sum(n for _, n in pieces) == 64 or s == max(at)
    whole = sorted(tuple(library.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in hard.collect())
    # Joined in stream order the pieces are the documents, in some order.
    stream = [i for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])) for i in np.frombuffer(r["ids"], "<u2").tolist()]
    docs, k = [], 0
    for r in sorted((r for r in rows if r["start"] == 0), key=lambda r: (r["sequence_id"], r["offset"])):
        docs.append(tuple(stream[k : k + r["doc_tokens"]]))
        k += r["doc_tokens"]
    assert sorted(docs) == whole and k == len(stream)
    assert packing.pack(spark, no_documents, byte_bpe).count() == 0


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_long_words_by_the_agenda(piece_bpe, monkeypatch, dropout):
    """Words merged alone have the pieces that they have when merged with others."""
    e = merge_dropout.Encoder(piece_bpe, dropout)
    r = np.random.default_rng(4)
    words = ["".join(r.choice(list("etaoinsé中▁"), 60)) for _ in range(50)] + [" " + "abc" * 20, "=" * 61]
    hashes = iter(())
    for w in words:
        together = e._merge([w])
        key = merge_dropout.ta.Hasher(np.frombuffer(w.encode("utf-32-le"), np.uint32)).spans(np.array([0]), np.array([len(w)]))
        hashes = iter([key])
        with monkeypatch.context() as m:
            m.setattr(merge_dropout.ta, "unit_hashes", lambda *a: next(hashes))
            assert [e._merge_long(w)] == together


def test_long_words_decode(piece_bpe):
    e = merge_dropout.Encoder(piece_bpe, 0.1)
    text = "x" * 20_000 + " " + "abé中" * 3000 + "▁ end"
    assert merge_dropout.Decoder(e.vocabulary)(e([text])[0]) == text


def test_permutation():
    for n in (1, 2, 5, 16, 17, 1000, 4097):
        p = training_order.Permutation(n)
        slots = p.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (p.sequences(slots) == np.arange(n)).all()
    assert (training_order.Permutation(1000, 1).slots(np.arange(1000)) != training_order.Permutation(1000, 2).slots(np.arange(1000))).any()


def test_shards(spark, hard, no_documents, byte_bpe, tmp_path):
    args = {"length": 64, "shard_rows": 16}
    folder = f"file://{tmp_path}/shards"
    n = training_order.write_shards(spark, hard, byte_bpe, folder, **args)
    rows = sorted(training_order.read_shards(spark, folder, n, **args).collect())
    assert [r["slot"] for r in rows] == list(range(n)) and sorted(r["sequence_id"] for r in rows) == list(range(n))
    pieces = packing.pack(spark, hard, byte_bpe, length=64).collect()
    stream = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        stream[r["sequence_id"]] = stream.get(r["sequence_id"], b"") + bytes(r["ids"])
    for r in rows:
        assert bytes(r["ids"]) == stream[r["sequence_id"]].ljust(128, b"\0")
        assert r["shard"] == r["slot"] // 16 and r["byte_offset"] == r["slot"] % 16 * 129
    late = training_order.read_shards(spark, folder, n, after_slot=20, **args).collect()
    assert sorted(r["slot"] for r in late) == list(range(21, n))
    # A reader needs no more than the file and the place.
    one = next((tmp_path / "shards/shard=1").glob("part-*")).read_bytes()
    assert one[129 * 2 : 129 * 2 + 128] == bytes(rows[18]["ids"])
    assert training_order.write_shards(spark, no_documents, byte_bpe, folder + "2") == 0
    assert training_order.read_shards(spark, folder + "2", 0).count() == 0


def test_shards_are_written_in_small_batches(spark, hard, byte_bpe, tmp_path, monkeypatch):
    name, seen, keep = "spark.sql.execution.arrow.maxRecordsPerBatch", [], training_order.Scratch.keep
    before = spark.conf.get(name)
    monkeypatch.setattr(training_order.Scratch, "keep", lambda self, df, table: seen.append(int(spark.conf.get(name))) or keep(self, df, table))
    training_order.write_shards(spark, hard, byte_bpe, "file://" + str(tmp_path / "shards"))
    assert max(seen) <= 1000 and spark.conf.get(name) == before


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=40), min_size=1, max_size=5), st.integers(0, 5))
def test_pieces(pieces, piece_bpe, texts, seed):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=piece_bpe)
    plain, decoder = merge_dropout.Encoder(pieces, 0.0, 0), merge_dropout.Decoder(pieces)
    for t, p in zip(texts, plain(texts), strict=True):
        assert decoder(p) == t
        if "▁" not in t:
            assert np.frombuffer(p, "<u2").tolist() == sp.encode(t)
    dropped = merge_dropout.Encoder(pieces, 0.3, seed)
    assert [decoder(p) for p in dropped(texts)] == texts


def plain_agenda(v, encoder, word):
    """The agenda by the book for one word of known characters: best score, then leftmost."""
    import numpy as np

    from tessera.llm import text_arrays as ta

    chars = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    key = ta.Hasher(chars).spans(np.array([0]), np.array([len(chars)]))
    symbols = [(i, i + 1, v.char_id.get(c if c != " " else "▁", -1)) for i, c in enumerate(word)]
    while True:
        best = None
        for k in range(len(symbols) - 1):
            (a, b, x), (_, c, y) = symbols[k], symbols[k + 1]
            rank, made = v.look_up(np.array([x]), np.array([y]))
            if rank[0] == merge_dropout._NONE or encoder._dropped(key, np.array([a]), np.array([b]), np.array([c]))[0]:
                continue
            if best is None or rank[0] < best[0]:
                best = (rank[0], k, (a, c, int(made[0])))
        if best is None:
            return [s[2] for s in symbols]
        symbols[best[1] : best[1] + 2] = [best[2]]


def test_dropout_follows_the_agenda(piece_bpe):
    encoder, _ = merge_dropout._worker_copy(piece_bpe, 0.3, 4)
    words = [" reading", " international", " thntonthered", " the", " aaaaaaa", " anedhe.", " Étion"]
    for w in words:
        assert np.frombuffer(encoder._merge([w])[0], "<u2").tolist() == plain_agenda(encoder.vocabulary, encoder, w)
    other, _ = merge_dropout._worker_copy(piece_bpe, 0.3, 5)
    assert encoder([" ".join(words)]) != other([" ".join(words)])


def test_pieces_of_tables(hard, no_documents, piece_bpe):
    assert all(r["lossless"] for r in merge_dropout.round_trip(hard, piece_bpe).collect())
    texts = sorted((r["text"] for r in merge_dropout.decode(merge_dropout.encode(hard, piece_bpe), piece_bpe).collect()))
    assert texts == sorted(r["text"] or "" for r in hard.collect())
    assert merge_dropout.round_trip(no_documents, piece_bpe).count() == 0
