"""The pipeline's stages, each against a plain computation on its own input."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from hydroframe.llm.common import stored
from tests.llm.test_quality_rules import plain as plain_statistics
from tests.llm.test_simhash import plain_print, plain_roots

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    """What goes into each stage, and what comes out of the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made.append(stored(stage(spark, made[-1], SF), "stage"))
    return made


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages_keep_the_columns(tables):
    for table in tables[:5]:
        assert table.schema.names == tables[0].schema.names
        assert [f.dataType for f in table.schema] == [f.dataType for f in tables[0].schema]
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "substring_dedup", "secret_scans", "best_fit_packing",
    ]


def test_quality_keeps_good_documents_and_no_bad_ones(spark, tables):
    before, after = rows(tables[0]), rows(tables[1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for doc, r in before.items():
        n_words, _, _, _, repeated = plain_statistics(r.text)
        failed = n_words < 50 or 100 * repeated > 50 * n_words
        assert doc not in after if failed else True
        if not failed and labels.get(doc) is not None:
            assert (doc in after) == (labels[doc] == 1)
    assert all(after[doc] == before[doc] for doc in after)


def test_one_document_of_each_group_stays(tables):
    before, after = rows(tables[1]), rows(tables[2])
    prints = {doc: plain_print(r.text) for doc, r in before.items()}
    roots = plain_roots(prints.values(), 4)
    least = {}
    for doc, p in prints.items():
        least[roots[p]] = min(doc, least.get(roots[p], doc))
    assert set(after) == set(least.values())
    assert all(after[doc] == before[doc] for doc in after)


def test_repeated_passages_go(tables):
    before, after = rows(tables[2]), rows(tables[3])
    words = {doc: r.text.encode().split() for doc, r in before.items()}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    for doc, own in words.items():
        gone = set()
        for i in range(len(own) - 34):
            if seen[tuple(own[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        kept = [w for i, w in enumerate(own) if i not in gone]
        if not kept:
            assert doc not in after
        else:
            assert after[doc].text.encode().split() == kept
            assert after[doc].n_chars == len(after[doc].text) if gone else after[doc] == before[doc]


def test_secrets_go(tables):
    before, after = rows(tables[3]), rows(tables[4])
    secret = re.compile(r'(token = ")[0-9a-f]{40}(?=")', re.I)
    assert before.keys() == after.keys()
    for doc, r in before.items():
        assert after[doc].text == secret.sub(r"\1[SECRET]", r.text)
        assert after[doc].n_chars == len(after[doc].text)


def test_every_token_is_packed(tables):
    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    model.encode_special_tokens = True
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in tables[5].collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    docs = rows(tables[4])
    assert pieces.keys() == docs.keys()
    for doc, r in docs.items():
        ids = [*model.encode(r.text, add_special_tokens=False).ids, 1]
        want = [(n, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes()))
                for n, at in enumerate(range(0, len(ids), 4096))]
        assert sorted((p.piece, p.start, p.length, p.ids_crc32) for p in pieces[doc]) == want
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096


def test_run_gives_the_last_stages_rows(spark, tables):
    got = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got.collect())) == sorted(map(key, tables[5].collect()))
