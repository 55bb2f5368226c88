"""Every operator over the smallest tables, against a plain version or the library itself."""

import base64
import hashlib
import math
import zlib

import numpy as np
import pandas as pd
import pytest
from brute import linked, overlaps, personal_data, without_repeats, written
from compare import connect, differences

from civicpulse.llm import jaccard
from civicpulse.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF_DIR}/documents.parquet").sort_values("doc_id", ignore_index=True)


@pytest.fixture(scope="module")
def result(spark):
    found = {}

    def of(name):
        if name not in found:
            found[name] = QUERIES[name](spark, SF_DIR).toPandas()
        return found[name]

    return of


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) == []


def test_personal_data(documents, result):
    rows = result("op2_personal_data").set_index("doc_id")
    for doc_id, text in zip(documents.doc_id, documents.text):
        spans, row = personal_data(text), rows.loc[doc_id]
        assert [row[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [
            sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")
        ]
        assert row.base_sha256 == hashlib.sha256(written(spans).encode()).hexdigest()
        assert set(filter(None, written(spans).split(","))) <= set(row.spans.split(","))


def test_repeated_passages(documents, result):
    rows = result("op3_repeated_passages").sort_values("doc_id")
    got = list(zip(rows.n_words, rows.n_removed, rows.kept_sha256))
    assert got == without_repeats(documents.text.tolist())
    assert rows.n_removed.sum() > 0


def test_token_counts(documents, result):
    import public_tokenizers
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = result("op4_token_counts").sort_values("doc_id")
    counts = [len(ids) for ids in processor.encode(documents.text.fillna("").tolist())]
    assert rows.n_tokens.tolist() == counts
    assert rows.n_bytes.tolist() == [len((t or "").encode()) for t in documents.text]
    assert rows.over_limit.tolist() == [n > 4096 for n in counts]


def test_nearest_neighbours(result):
    table = pd.read_parquet(f"{SF_DIR}/embeddings.parquet")
    vectors, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    rows, hits, total = result("op5_nearest_neighbours"), 0, 0
    assert set(rows.query_id) == set(ids[ids % 100 == 0])
    for query, found in rows.groupby("query_id"):
        own = int(np.flatnonzero(ids == query)[0])
        distance = np.sqrt(((vectors - vectors[own]) ** 2).sum(1))
        distance[own] = np.inf
        order = np.lexsort((ids, distance))[:10]
        found = found.sort_values("rank")
        assert found["rank"].tolist() == list(range(1, 11)) and found.score.is_monotonic_increasing
        by_id = dict(zip(ids, distance))
        assert np.allclose(found.score, [by_id[v] for v in found.vec_id], rtol=1e-14)
        hits, total = hits + len(set(found.vec_id) & set(ids[order])), total + 10
    assert hits / total >= 0.9


def test_decontamination(documents, result):
    items = pd.read_parquet(f"{SF_DIR}/benchmark.parquet")
    rows = result("op6_decontamination")
    found = set(zip(rows.doc_id, rows.item_id))
    short = documents[documents.text.str.len() < 3000]
    expected = {(d, i) for d, t in zip(short.doc_id, short.text) for i, q in zip(items.item_id, items.text) if _share(t, q) and overlaps(t, q)}
    assert {p for p in found if p[0] in set(short.doc_id)} == expected


def _share(text, item):
    return len(set(text.lower().split()) & set(item.lower().split())) >= 6


def test_packing(documents, result):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = result("op8_packing").sort_values(["doc_id", "piece"])
    by_id = dict(tuple(rows.groupby("doc_id")))
    for doc_id, text in zip(documents.doc_id, documents.text):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = by_id[doc_id]
        assert own.length.sum() == len(ids) and own.piece.tolist() == list(range(len(own)))
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1]]
        assert own.length.iloc[1:].eq(2048).all() and (len(own) == 1) == (len(ids) <= 2048)
        for start, length, crc in zip(own.start, own.length, own.ids_crc32):
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc
    placed = rows.sort_values(["sequence_id", "offset"])
    ends = (placed.offset + placed.length).groupby(placed.sequence_id)
    assert (ends.shift(1).fillna(0) == placed.offset).all() and ends.max().max() <= 2048
    assert rows.sequence_id.nunique() <= 1.03 * rows.length.sum() / 2048 + 1


def test_jaccard_join(documents, result):
    rows = result("op9_jaccard_join").sort_values("doc_id")
    links, root = linked(documents.text.tolist())
    assert rows.n_links.tolist() == links
    assert rows.class_id.tolist() == documents.doc_id.to_numpy()[root].tolist()
    assert sum(links) > 0


def test_quality_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op10_quality"](spark, sf_dir).toPandas()
    held = [zlib.crc32(str(d).encode()) % 4 == 2 for d in rows.doc_id]
    assert rows.held_out.tolist() == held
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.7) == (rows.predicted == 1)).all()
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet")
    both = rows[rows.held_out].merge(labels, on="doc_id")
    assert len(both) > 50 and (both.predicted == both.quality).mean() >= 0.95


def test_vocabularies_of_two_libraries_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    from civicpulse.llm.packing import token_ids

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "a<|endoftext|>b", "it's 'S  x\n\n\ty ", "é" * 900, " " * 900, "\x00\r\n", "日本語 👩‍👩‍👧", "x" * 399 + " " + "y" * 401]
    for low in [*range(0, 0x40000, 64), *range(0xE0000, 0xE0200, 64)]:
        texts.append(" ".join(f"a{chr(c)}1 {chr(c)}b{chr(c)}{chr(c)}" for c in range(low, low + 64) if not 0xD800 <= c < 0xE000))
    texts += [base64.b64encode(bytes(range(i, 200))).decode() for i in range(0, 100, 7)]
    for text in texts:
        assert token_ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("bucket", [8, jaccard.BUCKET])
def test_recall_of_pairs_at_the_threshold(spark, monkeypatch, bucket):
    """Planted pairs of similarity 0.8 among texts that share half their shingles, so buckets are split."""
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    shared = [f"s{i}" for i in range(24)]
    rows = []
    for pair in range(1200):
        common = shared + [f"p{pair}_{i}" for i in range(20)]
        rows += [(2 * pair + side, " ".join(common + [f"own{pair}_{side}_{i}" for i in range(5)])) for side in (0, 1)]
    found = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == {d: (d - d % 2, 1) for d, _ in rows}


def test_the_stated_recall_holds_after_all_splits():
    chance = 1 - (1 - jaccard.survival()) ** jaccard.runs()
    assert chance >= jaccard.RECALL and jaccard.survival() < 0.8 * 0.97**jaccard.DEPTH
    fewer = sum(math.comb(jaccard.SAMPLES, i) * 0.8**i * 0.2 ** (jaccard.SAMPLES - i) for i in range(jaccard.PROMISING))
    assert fewer < 1 - jaccard.RECALL
