"""Token counts, token files and packing against the library itself."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strata.llm import packing, simple8b
from strata.llm.bpe import Encoder, encoder
from strata.llm.queries import QUERIES
from strata.llm.token_counts import count_tokens

SF_DIR = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t ab'sÉ1.<|endoftext>\x1c　"), max_size=40), max_size=8))
def test_pieces_encode_like_whole_texts(texts):
    assert [x.tolist() for x in encoder("byte_bpe_50k.json").ids(texts)] == [plain_ids(t) for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(name):
    texts = ["Hello  wide world", "", "a b", "É <|endoftext|> x"]
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        expected = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    else:
        expected = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in Encoder(path).ids(texts)] == expected


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr("strata.llm.bpe.REMEMBERED", 3)
    own = Encoder("byte_bpe_50k.json")
    for text in ("a b c d e f", "b c x y", "a b c d e f"):
        assert own.ids([text])[0].tolist() == plain_ids(text) and own.counts([text]) == [len(plain_ids(text))]


def test_counts(spark, messy, nothing):
    rows = count_tokens(messy.select("doc_id", "text", F.col("text").alias("kept"))).collect()
    assert [r.n_tokens for r in rows] == [len(plain_ids(r.kept)) for r in rows]
    assert [r.n_bytes for r in rows] == [len((r.kept or "").encode()) for r in rows]
    assert [r.over_limit for r in rows] == [r.n_tokens > 512 for r in rows]
    assert count_tokens(nothing).count() == 0


def test_count_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op8_token_counts"](spark, SF_DIR).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {k: len(plain_ids(t)) for k, t in texts.items()}


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**60 - 1), st.just(0)), max_size=700))
def test_simple8b_round_trip(ids):
    words = simple8b.pack(np.array(ids, dtype=np.uint64))
    assert simple8b.unpack(words, len(ids)).tolist() == ids


def test_simple8b_packs_runs_and_refuses_wide_ids():
    assert len(simple8b.pack(np.zeros(480, np.uint64))) == 2
    assert len(simple8b.pack(np.full(60, 1, np.uint64))) == 1
    with pytest.raises(ValueError):
        simple8b.pack(np.array([2**60], np.uint64))
    ids, lengths = simple8b.read_block(simple8b.write_block([np.array([5, 6]), np.array([], int), np.array([2**40])]))
    assert ids.tolist() == [5, 6, 2**40] and lengths.tolist() == [2, 0, 1]
    with pytest.raises(ValueError):
        simple8b.read_block(b"nothing")


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_files_query(spark):
    start = 0
    rows = {r.doc_id: r for r in QUERIES["op3_simple8b"](spark, SF_DIR).collect()}
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect():
        ids = [*plain_ids(r.text), 0]
        assert rows[r.doc_id][1:] == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(rows) == 200


def test_token_files_of_messy_rows(spark, messy, nothing, tmp_path, monkeypatch):
    monkeypatch.setattr(simple8b, "BLOCK_IDS", 50)
    simple8b.write_tokens(messy, str(tmp_path / "t"), partitions=3)
    rows = simple8b.read_tokens(spark, str(tmp_path / "t"), with_ids=True).orderBy("start").collect()
    order = messy.orderBy(F.col("doc_id").asc_nulls_first(), "text").collect()
    expected = [(r.doc_id, [*plain_ids(r.text), 0]) for r in order]
    assert [(r.doc_id, r.ids) for r in rows] == expected
    assert [r.start for r in rows] == np.cumsum([0] + [len(i) for _, i in expected])[:-1].tolist()
    assert simple8b.token_index(nothing).count() == 0


def check_packing(rows, texts, capacity):
    """Every document whole and in pieces as agreed, every sequence gapless and within the capacity."""
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, text in texts:
        ids, at = [*plain_ids(text), 0], 0
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        for k, r in enumerate(pieces):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, crc(ids[at : at + r.length])) and (k == 0 or r.length == capacity)
            at += r.length
        assert at == len(ids) and len(pieces) == -(-len(ids) // capacity)
    return len(by_sequence)


def test_packing_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    rows = QUERIES["op9_packing"](spark, SF_DIR).collect()
    used = check_packing(rows, texts, 2048)
    least = -(-sum(len(plain_ids(t)) + 1 for _, t in texts) // 2048)
    assert least <= used <= least + 1


def test_packing_messy_rows(spark, messy, nothing):
    texts = [(r.doc_id, r.text) for r in messy.where("doc_id > 1").collect()]
    packed = packing.pack_documents(messy, capacity=64, with_ids=True)
    rows = packed.collect()
    check_packing(rows, [], 64)
    assert sum(r.length for r in rows) == sum(len(plain_ids(r.text)) + 1 for r in messy.collect())
    check_packing(packing.pack_documents(messy.where("doc_id > 1"), capacity=64).collect(), texts, 64)
    sequences = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in rows:
        assert sequences[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert packing.pack_documents(nothing).count() == 0


@given(st.lists(st.integers(1, 30), max_size=200))
def test_plans_use_every_piece_once(lengths):
    counts = np.bincount(np.array(lengths, dtype=int), minlength=31)
    plan = packing.plan_packing(counts, 30)
    filled, placed = np.zeros(plan.sequences, int), np.zeros(31, int)
    for k in range(len(plan.length)):
        following = plan.first[k + 1] if k + 1 < len(plan.length) and plan.length[k + 1] == plan.length[k] else counts[plan.length[k]]
        times = following - plan.first[k]
        filled[plan.sequence[k] : plan.sequence[k] + times] += plan.length[k]
        placed[plan.length[k]] += times
    assert (placed == counts).all() and (filled <= 30).all() and (filled > 0).all()


def test_exact_complements_are_found():
    counts = np.zeros(101, int)
    counts[[60, 30, 9, 1]] = 5
    assert packing.plan_packing(counts, 100).sequences == 5


def test_index_of_sums_against_search():
    rng = np.random.default_rng(8)
    for _ in range(40):
        counts = rng.integers(0, 4, 40) * (rng.random(40) < 0.5)
        counts[0] = 0
        index = packing.SumIndex(counts)
        for _ in range(60):
            total = int(rng.integers(1, 40))
            lengths = np.flatnonzero(index.left).tolist()
            found = index.exact(total)
            fits = [
                c
                for k in (1, 2, 3)
                for c in itertools.combinations_with_replacement(lengths[::-1], k)
                if sum(c) == total and all(index.left[x] >= c.count(x) for x in c)
            ]
            assert (sorted(found, reverse=True) if found else None) == (max((list(c) for c in fits if len(c) == len(fits[0])), default=None) if fits else None)
            if found:
                np.subtract.at(index.left, list(found), 1)
    assert packing.plan_packing(np.array([0, 0, 3]), 2).sequences == 3


def test_pack_leaves_out_packings_without_long_runs(monkeypatch):
    """Ids are scanned again only for packings that the runs found so far are long enough for; the words stay the greedy ones."""
    plain, scanned = np.flatnonzero, []
    monkeypatch.setattr(np, "flatnonzero", lambda values: (scanned.append(len(values)), plain(values))[1])
    ids = np.append(np.full(1000, 40_000), [3, 0, 0, 0])
    words = simple8b.pack(ids)
    monkeypatch.undo()
    assert sum(scanned[:13]) < 3 * len(ids)
    assert (simple8b.unpack(words, len(ids)) == ids).all()
    at = 0
    for selector in (words & np.uint64(15)).astype(int).tolist():
        fits = lambda s: not (ids[at : at + simple8b.COUNTS[s]] >> simple8b.WIDTHS[s]).any()
        assert selector == next(s for s in range(16) if fits(s))
        at += simple8b.COUNTS[selector]


@given(st.lists(st.text(alphabet=st.sampled_from(" \n aé'’.,!_-#1²٣½ªß中𞤀ꟑ́ͅ‍😀"), max_size=30), max_size=8))
def test_words_with_marks_encode_like_whole_texts(texts):
    expected = [plain_ids(t) for t in texts]
    assert [x.tolist() for x in Encoder("byte_bpe_50k.json").ids(texts)] == expected
    column = pa.array([None, "left out", *texts, None, ""]).slice(2)
    assert [x.tolist() for x in encoder("byte_bpe_50k.json").ids(column)] == [*expected, [], []]
    assert encoder("byte_bpe_50k.json").counts(column) == [*map(len, expected), 0, 0]


def test_words_are_encoded_once_whatever_marks_follow():
    own, given = Encoder("byte_bpe_50k.json"), []
    whole, tokens = own._whole, own._tokens
    own._whole, own._tokens = lambda texts: (given.extend(texts), whole(texts))[1], lambda word: (given.append(word), tokens(word))[1]
    words = [a + b + c for a in ("river", "Straße", "ñandú") for b in ("bank", "ging") for c in "abcdefgh"]
    text = " ".join(w + mark for mark in ("", ",", ".", "!?", "***") for w in words)
    assert own.ids([text, text])[0].tolist() == plain_ids(text)
    assert sum(map(len, given)) < 2 * len(" ".join(words))


def test_forgetting_keeps_the_most_frequent_pieces(monkeypatch):
    monkeypatch.setattr("strata.llm.bpe.REMEMBERED", 8)
    own = Encoder("byte_bpe_50k.json")
    text = " ".join(c * (9 if c in "xyz" else 2) for c in "abcdefghxyz" for _ in range(40 if c in "xyz" else 2))
    assert own.ids([text])[0].tolist() == plain_ids(text)
    own._forget()
    assert set(own._later) == {"xxxxxxxxx", "yyyyyyyyy", "zzzzzzzzz"}
    assert own.ids([text])[0].tolist() == plain_ids(text)


def test_pack_scans_no_ids_for_each_packing(monkeypatch):
    """Where each packing fits follows from sliding maxima of bytes; only words are searched by selector."""
    plain, scanned = np.flatnonzero, []
    ids = np.random.default_rng(3).zipf(1.2, 5_000).clip(0, 50_256).astype(np.uint64)
    monkeypatch.setattr(np, "flatnonzero", lambda values: (scanned.append(len(values)), plain(values))[1])
    words = simple8b.pack(ids)
    monkeypatch.undo()
    assert max(scanned) == len(words) < len(ids)
    assert (simple8b.unpack(words, len(ids)) == ids).all()
