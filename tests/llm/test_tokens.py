import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from circdesk.llm import tokens
from circdesk.llm.id_files import Index, PerfectHash, look_up, read_documents, write_ids
from circdesk.llm.packing import Bins, pack, sequences, token_pieces
from tests.llm.cases import awkward_rows, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _ids(text):
    tokenizer = _ids.__dict__.setdefault("tokenizer", Tokenizer.from_file(PATH))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_of_odd_texts(spark):
    draw = random.Random(5)
    letters = "ab Z'9 \t\n\r\u000b\u000c\u001c\u0085 éß你ñ%'s't'll! 　😀́ͅ१ⅷ‍_'re"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(600)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> <|endoftext", "你<|endoftext|>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in token_pieces(rows, PATH, with_ids=True).collect()}
    assert all(got[i].ids == _ids(t) and got[i].ids_crc32 == _crc(_ids(t)) for i, t in enumerate(texts))


def test_packing_loses_nothing(awkward, nothing):
    packed = pack(token_pieces(awkward, PATH, with_ids=True), open_bins=3)
    got = packed.collect()
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)))
    want = defaultdict(list)
    for i, t in documents(awkward_rows()):
        ids, start = _ids(t), 0
        for n in range(-(-len(ids) // 1024)):
            stop = len(ids) - 1024 * (-(-len(ids) // 1024) - 1 - n)
            want[i].append((n, start, stop - start, _crc(ids[start:stop]), tuple(ids[start:stop])))
            start = stop
    assert {k: Counter(v) for k, v in found.items()} == {k: Counter(v) for k, v in want.items()}
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length, r.ids))
    for parts in bins.values():
        at = 0
        for offset, length, _ in sorted(parts, key=lambda p: p[0]):
            assert offset == at
            at += length
        assert at <= 1024
    whole = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    assert whole == {k: [x for p in sorted(v, key=lambda p: p[0]) for x in p[2]] for k, v in bins.items()}
    assert pack(token_pieces(nothing, PATH)).collect() == []


def test_packing_is_tight(spark):
    rows = spark.range(20_000).selectExpr(
        "id doc_id", "0 piece", "0L start", "1 + pmod(hash(id), 1024) length", "0L ids_crc32").repartition(8)
    rows = rows.withColumn("length", rows.length.cast("long"))
    got = pack(rows).groupBy("sequence_id").sum("length").collect()
    total = sum(r[1] for r in got)
    assert len(got) <= 1.01 * total / 1024 + 1 and max(r[1] for r in got) <= 1024


def test_the_fullest_bin_closes_first():
    bins = Bins(10, 2)
    assert bins.place(6, 0) == (0, 0, None)
    assert bins.place(7, 1) == (1, 0, None)
    assert bins.place(8, 2) == (2, 0, 2)
    assert bins.place(3, 3) == (1, 7, None)
    assert bins.place(4, 4) == (0, 6, None)
    assert bins.rest() == []


def test_files_hold_every_document(spark, awkward, nothing):
    shards = write_ids(awkward, PATH)
    got = read_documents(shards, with_ids=True).collect()
    rows = sorted(documents(awkward_rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(_ids(t))) for i, t in rows)
    at, before = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == _crc(r.ids)
        assert before is None or r.doc_id >= before
        at, before = at + r.n_tokens, r.doc_id
    asked = spark.createDataFrame([(5,), (6,), (10,), (999,), (None,), (-1,)], "doc_id long")
    found = Counter((r.doc_id, tuple(r.ids)) for r in look_up(shards, asked).collect())
    assert found == Counter((i, tuple(_ids(t))) for i, t in rows if i in (5, 6, 10))
    empty = write_ids(nothing, PATH)
    assert read_documents(empty).collect() == [] and look_up(empty, asked).collect() == []


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 20_000)
    table = PerfectHash.build(keys.view(np.uint64))
    assert sorted(table.slots(keys.view(np.uint64))) == list(range(len(keys)))
    doc_ids = np.sort(np.concatenate([keys, keys[:50]]))
    index = Index.from_bytes(Index(doc_ids, np.arange(len(doc_ids) + 1), 0).to_bytes())
    first, count = index.rows(keys)
    assert (doc_ids[first] == keys).all() and (count[:50] == 2).all() and (count[50:] == 1).all()
    strange = np.setdiff1d(np.arange(2000), keys)
    assert index.rows(strange)[1].sum() <= 1


def test_slices_are_bounded_and_pieces_kept(monkeypatch):
    monkeypatch.setattr(tokens, "_ROWS", 4)
    monkeypatch.setattr(tokens, "_PIECES", 10)
    lengths = [3, 3, 3, 3, 3, 30, 0, 0, 0, 0, 0, 2]
    column = pa.StructArray.from_arrays(
        [pa.array([["a"] * n for n in lengths], pa.list_(pa.string())), pa.nulls(12, pa.string())], ["cuts", "whole"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), column], names=["doc_id", "cut"])
    found = [s.column("doc_id").to_pylist() for s in tokens.slices([batch, batch.slice(5, 3), batch.slice(0, 0)])]
    assert found == [[0, 1, 2], [3, 4], [5], [6, 7, 8, 9], [10, 11], [5], [6, 7]]
    monkeypatch.setattr(tokens, "_CACHED", 2)
    encode = tokens.Encoder(PATH)
    want = [x for n in lengths for x in _ids("a" * n)[:0] + _ids("a")[:-1] * n + [2]]
    assert encode.ids(column, 2)[0].tolist() == want
    for piece in ("a", "b", "c", "a", "d"):  # "a" is used again and stays, "b" leaves
        assert (encode.known.get(piece) or encode._piece(piece)) == np.array(_ids(piece)[:-1], np.uint16).tobytes()
    assert len(encode.known) <= 2 and "a" in {**encode.known, **encode.older}


def test_marked_texts_give_the_ids_of_whole_texts(spark):
    texts = ["a\0b", "\0", "", None, "it's a\u00a0b", "don't  stop\n\n x's", "'s's '"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = rows.coalesce(1).select("doc_id", tokens.cut(rows.text, PATH).alias("cut")).toArrow().to_batches()
    assert pa.Table.from_batches(made).column("cut").combine_chunks().field("marked").null_count == 2
    encode = tokens.Encoder(PATH)
    got = []
    for batch in tokens.slices(tokens.split(made)):
        ids, at = encode.ids(batch.column("cut"), 2)
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert got == [_ids(t) for t in texts]


def test_listed_pieces_are_bounded_and_those_used_stay(monkeypatch):
    monkeypatch.setattr(tokens, "_LISTED", 3)
    monkeypatch.setattr(tokens, "_CACHED", 2)
    encode = tokens.Encoder(PATH)
    for words in (["one", "two", "one"], ["one", "three", "four"], ["one", "five"], ["two", "one"], []):
        column = pa.StructArray.from_arrays([pa.array([words], pa.list_(pa.string())), pa.nulls(1, pa.string())], ["cuts", "whole"])
        assert encode.ids(column, 2)[0].tolist() == [x for w in words for x in _ids(w)[:-1]] + [2]
        assert len(encode.listed) <= 3 + len(words) and len(encode.listed) == len(encode.at) - 1 == len(encode.used)
    assert "one" in encode.listed.to_pylist() and len(encode.known) <= 2
