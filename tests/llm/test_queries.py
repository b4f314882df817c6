"""Every query of the folder on whole small tables: its contract's columns, and rows as SQL or a plain version gives them."""

import glob
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from lociforge.llm import queries as q
from tests.llm.test_text import plain_measure, plain_spans

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_token_counts": ["doc_id", "n_tokens"],
    "op2_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op3_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4_html_text": ["page_id", "url", "text", "n_chars"],
    "op5_simhash": ["doc_id", "fingerprint", "component_id"],
    "op6_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op7_automata_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op8_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op9_sentencepiece": ["doc_id"],
    "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op11_source_divergence": ["lang", "source", "part", "item", "value", "rank"],
    "op12_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op13_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
}
KINDS = {"bigint": {"n_tokens", "start", "n_bytes", "n_removed", "n_spans", "ids_crc32", "n_chars", "n_words", "n_hit", "n_items", "value", "length", "doc_tokens", "sequence_id", "offset", "positive_score", "negative_score"}, "boolean": {"kept", "base_failed", "contaminated"}, "int": {"rank"}}


@pytest.fixture(scope="module")
def rows(spark, tokenizers_dir):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    found = {}

    def of(name):
        if name not in found:
            df = q.QUERIES[name](spark, DATA)
            found[name] = df.dtypes, df.collect()
        return found[name][1]

    of.types = lambda name: dict((of(name), found[name][0])[1])
    return of


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_columns(rows, name):
    types = rows.types(name)
    assert list(types)[: len(COLUMNS[name])] == COLUMNS[name] and rows(name)
    for kind, names in KINDS.items():
        assert all(types[c] == kind for c in names & set(COLUMNS[name]))


def test_every_query_is_here():
    assert set(q.QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", list(q.ORACLE_SQL))
def test_rows_are_those_of_sql(rows, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(q.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(rows.types(name))
    assert sorted(tuple(r[c] for c in want.columns) for r in rows(name)) == sorted(want.fetchall())


def test_token_ids(rows, texts, tokenizers_dir):
    from tokenizers import Tokenizer

    word, byte = (Tokenizer.from_file(tokenizers_dir.path(f)) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    ids = lambda t, x: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")
    own = {k: ids(word, x) for k, x in texts.items()}
    start = dict(zip(sorted(own), np.cumsum([0] + [len(own[k]) for k in sorted(own)]).tolist(), strict=False))
    assert sorted(map(tuple, rows("op3_token_files"))) == sorted((k, start[k], len(x), zlib.crc32(x.tobytes())) for k, x in own.items())
    word.encode_special_tokens = True
    assert sorted(map(tuple, rows("op1_token_counts"))) == sorted((k, len(word.encode(x, add_special_tokens=False).ids)) for k, x in texts.items())
    coded, length = {k: ids(byte, x) for k, x in texts.items()}, {}
    for r in rows("op12_packing"):
        assert r["doc_tokens"] == len(coded[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(coded[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        length[r["sequence_id"]] = length.get(r["sequence_id"], 0) + r["length"]
    assert sum(length.values()) == sum(map(len, coded.values())) and all(n == 2048 or n < 2048 and n & (n - 1) == 0 for n in length.values())


def test_fingerprints(rows, texts):
    import xxhash

    prints = {}
    for k, x in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    component = {k: k for k in prints}
    for _ in prints:
        new = {a: min(component[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2) for a in prints}
        if new == component:
            break
        component = new
    assert sorted(map(tuple, rows("op5_simhash"))) == sorted((k, f"{prints[k]:016x}", component[k]) for k in prints)


def test_spans_and_measures(rows, texts):
    for r in rows("op6_pii"):
        base = plain_spans(texts[r["doc_id"]])
        told = ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest() and set(told.split(",")) - {""} <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[3] == k for s in base) for k in ("email", "ip", "card", "phone")]
    for r in rows("op10_quality_rules"):
        n, *rest, repeats = plain_measure(texts[r["doc_id"]])
        assert [r[c] for c in COLUMNS["op10_quality_rules"][1:6]] == [n, *rest, repeats]
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n) and not (r["base_failed"] and r["kept"])


def test_pages_and_pieces(rows, spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = rows("op4_html_text")
    assert {r["page_id"] for r in got} == set(pages) and all(r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"] for r in got)
    assert len(rows("op9_sentencepiece")) == 200
