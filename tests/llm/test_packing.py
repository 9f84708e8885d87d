import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import bfd_packing, packing
from docspark.llm.queries import vocabulary
from docspark.llm.token_ids import Encoder, HashTable
from docspark.session import table, written


def whole(tokenizer, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer)
    return [[*own.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def check_pieces(rows, want):
    """want: doc_id -> list of its ids, one for each row of that id."""
    sequences, docs = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        docs.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert docs.keys() == want.keys()
    for i, pieces in docs.items():
        got = [x for _, ids, _ in sorted(pieces) for x in ids]
        assert sorted(got) == sorted(x for ids in want[i] for x in ids)
        assert {n for _, _, n in pieces} == {len(ids) for ids in want[i]}
        if len(want[i]) == 1:
            assert got == want[i][0]
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at.bit_count() == 1 else 2048 - at
    return padding, sum(len(x) for ids in want.values() for x in ids)


def test_pieces_hold_each_id_once(spark, odd_docs, odd_texts, tokenizer):
    want = {}
    for (i, _), ids in zip(odd_texts, whole(tokenizer, [t for _, t in odd_texts]), strict=True):
        want.setdefault(i, []).append(ids)
    padding, tokens = check_pieces(packing.pack(odd_docs.repartition(3), tokenizer).collect(), want)
    assert padding < 0.02 * tokens


def test_little_padding_on_documents(spark, sf_dir, tokenizer):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: [ids] for r, ids in zip(rows, whole(tokenizer, [r.text for r in rows]), strict=True)}
    padding, tokens = check_pieces(packing.pack(docs, tokenizer).collect(), want)
    assert padding < 0.01 * tokens
    digests = packing.digests(packing.pack(docs, tokenizer)).where("start = 0 and length = doc_tokens").collect()
    assert digests and all(zlib.crc32(np.array(want[r.doc_id][0], "<u4").tobytes()) == r.ids_crc32 for r in digests)


def test_cuts_are_the_cheapest_chain():
    rng = np.random.default_rng(1)
    for _ in range(60):
        at = np.unique(np.concatenate([[0], rng.integers(1, 120, 25), [120]]))
        cost = rng.integers(0, 5, len(at))
        if np.diff(at).max() > 16:
            continue
        least = {0: 0}
        for j in range(1, len(at)):
            options = []
            for i in range(j):
                n = at[j] - at[i]
                if n <= 16:
                    options.append(least[i] + 16 - n)
                if n in (8, 4, 2):
                    options.append(least[i] + packing.SHORT)
            least[j] = min(options) + cost[j]
        total, begin = 0, 0
        for end in packing.best_cuts(at, cost, 16):
            n = end - begin
            total += min(16 - n, packing.SHORT if n in (8, 4, 2) else 99) + cost[np.searchsorted(at, end)]
            begin = end
        assert total == least[len(at) - 1]


def test_segments_don_t_change_what_is_packed(odd_texts, tokenizer):
    own = Encoder(tokenizer)
    parts = []
    for i, t in odd_texts:
        raw = (t or "").encode()
        parts.append((np.array([i], object), own.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))))
    for segment in (3000, 1 << 30):
        out = list(packing.Stream(2048, segment).take(parts))
        assert sum(int(o["length"].sum()) for o in out) == sum(len(e.ids) for _, e in parts)
        ids = np.concatenate([np.frombuffer(o["ids"][0], "<u4") for o in out])
        assert ids.tolist() == np.concatenate([e.ids for _, e in parts]).tolist()


def test_tail_is_padded_or_powers_of_two():
    assert packing.powers_of_two(10, 1024) == [1034]
    assert packing.powers_of_two(0, 2047) == [2047]
    assert packing.powers_of_two(0, 1536) == [1024, 1536]


def test_encoder_is_the_tokenizer(odd_texts, tokenizer):
    own = Encoder(tokenizer)
    raw = [(t or "").encode() for _, t in odd_texts]
    bounds = np.cumsum([0, *map(len, raw)])
    e = own.encode(np.frombuffer(b"".join(raw), np.uint8), bounds)
    assert [e.ids[a:z].tolist() for a, z in zip(e.first, e.first[1:], strict=False)] == whole(tokenizer, [t for _, t in odd_texts])


def test_hash_table():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(1, 1 << 63, 5000, dtype=np.uint64))
    t = HashTable(4)
    for at in range(0, len(keys), 700):
        t.add(keys[at : at + 700])
    assert t.find(keys).tolist() == list(range(len(keys)))
    assert (t.find(rng.integers(1 << 63, (1 << 64) - 1, 1000, dtype=np.uint64)) == -1).all()


def test_empty_table(no_docs, tokenizer):
    assert packing.pack(no_docs, tokenizer).count() == 0
    assert bfd_packing.pack_matrix(no_docs, tokenizer).count() == 0


def test_matrix_round_trip(spark, odd_docs, odd_texts, tokenizer):
    want = {}
    for (i, _), ids in zip(odd_texts, whole(tokenizer, [t for _, t in odd_texts]), strict=True):
        want.setdefault(i, []).append(ids)
    pieces = {}
    rows = bfd_packing.pack_matrix(odd_docs.repartition(2), tokenizer, segment=9000).collect()
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert not ids[r.n_tokens :].any() and not positions[r.n_tokens :].any()
        for doc, start, a, z in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert positions[a:z].tolist() == list(range(z - a))
            pieces.setdefault(doc, []).append((start, ids[a:z].tolist()))
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, lists in want.items():
        got = [x for _, part in sorted(pieces[i]) for x in part]
        assert got == lists[0] if len(lists) == 1 else sorted(got) == sorted(x for ids in lists for x in ids)


def test_matrices_are_read_back(spark, odd_docs, no_docs, tokenizer, tmp_path):
    docs = odd_docs.unionByName(spark.createDataFrame([(None, "no id")], "doc_id long, text string"), allowMissingColumns=True).withColumn("ids", F.lit(b"x")).withColumn("starts", F.lit(0))
    for width in (64, 2048):
        packed = written(bfd_packing.pack_matrix(docs.repartition(3), tokenizer, width=width, segment=9000), "packed")
        wide = written(bfd_packing.write_matrices(packed, f"file://{tmp_path}/{width}w", width), "manifest")
        manifest = written(bfd_packing.write_matrices(packed, f"file://{tmp_path}/{width}", width, vocabulary(tokenizer)), "manifest")
        fields = ("n_tokens", "doc_ids", "starts", "cu_seqlens", "ids", "position_ids")
        key = lambda r: tuple(map(repr, (r[f] for f in fields)))
        assert sorted(map(key, bfd_packing.read_matrices(manifest, 7).collect())) == sorted(map(key, bfd_packing.read_matrices(wide).collect())) == sorted(map(key, packed.collect()))
        m = manifest.first()
        assert np.fromfile(m["ids"].removeprefix("file://"), "<u2").reshape(-1, width).shape == (m["rows"], width) and m.id_bytes == m.position_bytes == 2 and wide.first().id_bytes == 4
    with pytest.raises(Exception, match="below 300"):
        bfd_packing.write_matrices(packed, f"file://{tmp_path}/v", vocabulary=300).count()
    with pytest.raises(Exception, match="of width 32"):
        bfd_packing.write_matrices(packed, f"file://{tmp_path}/w", 32).count()
    empty = written(bfd_packing.write_matrices(bfd_packing.pack_matrix(no_docs, tokenizer), f"file://{tmp_path}/e"), "manifest")
    assert empty.count() == 0 and bfd_packing.read_matrices(empty).count() == 0


def test_positions_of_wide_rows(spark, tokenizer, tmp_path):
    docs = spark.createDataFrame([(1, "a b " * 70_000), (2, "c")], "doc_id long, text string").coalesce(1)
    wide = bfd_packing.pack_matrix(docs, tokenizer, width=100_000)
    rows = wide.collect()
    assert all(np.frombuffer(r.position_ids, "<u4")[: r.cu_seqlens[1]].tolist() == list(range(r.cu_seqlens[1])) for r in rows) and max(r.n_tokens for r in rows) == 100_000
    manifest = written(bfd_packing.write_matrices(wide, f"file://{tmp_path}/m", 100_000), "manifest")
    assert {bytes(r.position_ids) for r in bfd_packing.read_matrices(manifest).collect()} == {bytes(r.position_ids) for r in rows}


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_takes_the_least_room(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 65, 300)
    row_of, n = bfd_packing.best_fit_decreasing(sizes, 64)
    rooms: list[int] = []
    for k in np.argsort(-sizes, kind="stable"):
        fits = [r for r in rooms if r >= sizes[k]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - sizes[k])
        else:
            rooms.append(64 - sizes[k])
    assert n == len(rooms)
    assert np.bincount(row_of, sizes).max() <= 64


def test_other_names_of_columns(odd_docs, tokenizer):
    renamed = odd_docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.lit(1).alias("text"), F.lit("x").alias("ids"))
    assert packing.pack(renamed, tokenizer, "id", "body").agg(F.sum("length")).first()[0] > 1000
