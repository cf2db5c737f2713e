import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from gradus.llm import op3_packing, op5_rans, tokens

from .fixtures import DOCS, documents

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Zé'.,!\n\t\x85\xa0　Σİ9<|>_"), max_size=40), max_size=8))
def test_words_give_the_same_ids_as_whole_texts(path, texts):
    enc = tokens.encoder(path)
    plain = Tokenizer.from_file(path)
    for text, got in zip(texts, enc.encode(texts)):
        assert np.frombuffer(got, enc.width).tolist() == plain.encode(text, add_special_tokens=False).ids


def expected(path, end, rows=DOCS):
    plain = Tokenizer.from_file(path)
    return [(i, np.array(plain.encode(t or "", add_special_tokens=False).ids + [end], "<u4")) for i, t, *_ in rows]


def test_packing_is_gapless_and_whole(spark):
    pieces = op3_packing.pack(documents(spark), WORD, 2, window=64).collect()
    want = sorted(((i is None, i or 0), ids.tobytes()) for i, ids in expected(WORD, 2))
    assert sum(p["length"] for p in pieces) == sum(len(x) for _, x in expected(WORD, 2))
    spots = sorted((p["sequence_id"], p["offset"], p["length"]) for p in pieces)
    at = 0
    for s, o, n in spots:
        assert (s, o) == divmod(at, 64) and o + n <= 64
        at += n
    docs = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        if p["start"] == 0:
            docs.setdefault((p["doc_id"] is None, p["doc_id"] or 0), []).append(b"")
        docs[(p["doc_id"] is None, p["doc_id"] or 0)][-1] += p["ids"]
    assert sorted((k, x) for k, v in docs.items() for x in v) == want


def test_files_round_trip(spark, tmp_path):
    table = op5_rans.write(documents(spark), f"file://{tmp_path}/f", BYTE, 0, block_tokens=300)
    rows = op5_rans.read(spark, f"file://{tmp_path}/f", table).orderBy("start").collect()
    want = {(i, x.tobytes()) for i, x in expected(BYTE, 0)}
    assert {(r["doc_id"], r["ids"]) for r in rows} == want and len(rows) == len(DOCS)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


def test_rows_without_an_id_are_dealt_to_all_parts(spark, tmp_path):
    rows = [(i if i < 300 else None, f"text number {i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    most = max(len(x) for x in op5_rans.in_order(docs, 4).rdd.glom().collect())
    assert most <= 2000
    table = op5_rans.write(docs, f"file://{tmp_path}/n", BYTE, 0)
    got = op5_rans.read(spark, f"file://{tmp_path}/n", table).orderBy("start").collect()
    want = [(i, ids.tobytes()) for i, ids in expected(BYTE, 0, rows)]
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(i), x) for i, x in want)
    ids = [r["doc_id"] for r in got]
    assert ids[:3700] == [None] * 3700 and ids[3700:] == list(range(300))


def test_a_document_of_millions_of_ids(spark, tmp_path):
    """Longer than any block: its blocks are bounded, its ids are whole."""
    rows = [(1, "short"), (2, "w " * 2_500_000 + "end"), (3, "short too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = op5_rans.write(docs, f"file://{tmp_path}/f", BYTE, 0)
    got = {r["doc_id"]: r for r in op5_rans.read(spark, f"file://{tmp_path}/f", table).collect()}
    want = dict(expected(BYTE, 0, rows))
    assert {k: r["ids"] for k, r in got.items()} == {k: x.tobytes() for k, x in want.items()}
    assert got[3]["start"] == len(want[1]) + len(want[2]) and got[2]["n_tokens"] == len(want[2]) > 2_500_000
    ids = np.concatenate([np.arange(5_000_000) % 999, [7]])
    cut = op5_rans.frames(ids)
    assert max(map(len, cut)) <= op5_rans.MOST and (np.concatenate(cut) == ids).all()


def test_groups_round_trip():
    r = np.random.default_rng(3)
    groups = [r.integers(0, 300, n) for n in (1, 70_000, 5, 300_001, 0 + 64, 65_536, 65_537)]
    table = op5_rans.Table(op5_rans.scaled({i: 1 + i for i in range(300)}, 300))
    got = op5_rans.decoded_groups(op5_rans.coded_groups(groups, table), table)
    assert all((a == b).all() for a, b in zip(groups, got)) and len(got) == len(groups)


def test_empty_table_gives_no_rows(spark, tmp_path):
    none = documents(spark, DOCS[:0])
    assert op3_packing.pack(none, WORD, 2).count() == 0
    table = op5_rans.write(none, f"file://{tmp_path}/f", BYTE, 0)
    assert op5_rans.read(spark, f"file://{tmp_path}/f", table).count() == 0


def test_blocks_checkpoints_and_checksums():
    rng = np.random.default_rng(1)
    blocks = [rng.zipf(1.3, n) % 500 for n in (1, 63, 64, 65, 40_000, 70_000)]
    counts = np.bincount(np.concatenate(blocks), minlength=500)
    table = op5_rans.Table(op5_rans.scaled({i: int(n) for i, n in enumerate(counts) if n}, 500))
    coded = op5_rans.encode_blocks(blocks, table)
    assert all((a == b).all() for a, b in zip(blocks, op5_rans.decode_blocks(coded, table)))
    late = op5_rans.decode_blocks(coded[4:], table, checkpoint=2)
    assert all((a[2 * op5_rans.CHECK_STEPS * op5_rans.LANES :] == b).all() for a, b in zip(blocks[4:], late))
    bad = bytearray(coded[5])
    bad[len(bad) // 2] ^= 1
    with pytest.raises(ValueError):
        op5_rans.decode_blocks([bytes(bad)], table)
    assert zlib.crc32(coded[0][:-4]) == int.from_bytes(coded[0][-4:], "little")


def test_frequencies_sum_to_the_scale():
    for counts in ({3: 1}, {i: 1 for i in range(50_000)}, {i: 10**6 // (i + 1) + 1 for i in range(50_000)}):
        freq = op5_rans.scaled(counts, 50_257)
        assert freq.sum() == 1 << op5_rans.SCALE_BITS and all(freq[i] > 0 for i in counts)


def test_packing_beside_other_stages_holds_few_texts_at_once(spark, monkeypatch):
    batches = [pa.RecordBatch.from_pydict({"text": ["x" * 1000] * 256}) for _ in range(40)]
    sizes = [t.nbytes for t in tokens.gathered(iter(batches), most=tokens.FEW_BYTES)]
    assert max(sizes) < 1.1 * tokens.FEW_BYTES <= 0.3 * tokens.BYTES and sum(sizes) > 40 * 256_000
    asked = []
    monkeypatch.setattr(tokens, "gathered", lambda batches, column="text", most=tokens.BYTES: asked.append(most) or iter(()))
    monkeypatch.setattr(op3_packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, schema: list(f(iter(()))))
    for keep in (True, False):
        op3_packing.runs(documents(spark), WORD, 2, keep)
    assert asked == [tokens.BYTES, tokens.FEW_BYTES]


def test_packing_beside_other_stages_remembers_few_words(monkeypatch):
    """Words beyond them are encoded each time, with the same ids."""
    assert op3_packing.CACHE_WORDS <= 50_000 and tokens.FEW_BYTES <= 1 << 20
    enc = tokens.Encoder(WORD, 10)
    texts = pa.array([" ".join(f"word{k}x{j}" for j in range(30)) for k in range(20)])
    ids, n = enc.closed(texts, 2)
    whole, count = tokens.Encoder(WORD).closed(texts, 2)
    assert len(enc.known) <= 10 and (ids == whole).all() and (n == count).all()
