"""The registered queries against their SQL or plain Python, on the smallest tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from compare import connect, spark_rows, sql_rows
from placelens.llm.queries import LLM_QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", [n for n in LLM_QUERIES if n in entry.oracle_sql()])
def test_sql(spark, con, folder, name):
    assert spark_rows(LLM_QUERIES[name](spark, folder)) == sql_rows(con, entry.oracle_sql()[name])


def test_near_duplicates(spark, folder, texts):
    found = {r.doc_id: r for r in LLM_QUERIES["op6_near_duplicates"](spark, folder).collect()}
    sets, by_shingle = {}, defaultdict(list)
    for i, text in texts.items():
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        runs = [tuple(words[j : j + 3]) for j in range(len(words) - 2)] if len(words) > 2 else [tuple(words)] * bool(words)
        sets[i] = set(runs)
        for run in sets[i]:
            by_shingle[run].append(i)
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    shared = Counter((a, b) for ids in by_shingle.values() for a in ids for b in ids if a < b)
    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert set(found) == set(texts)
    for i, row in found.items():
        assert (row.n_shingles, row.component_id, row.kept) == (len(sets[i]), root(i), root(i) == i)
    assert len({root(i) for i in texts}) < len(texts)


def test_packing(spark, folder, texts):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = LLM_QUERIES["op3_best_fit_packing"](spark, folder).collect()
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, text in texts.items():
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        at = 0
        for number, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (number, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            assert r.length == 1024 or number == 0
            at += r.length
        assert at == len(ids)
        assert len(pieces[i]) == -(-len(ids) // 1024)
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-total // 1024) * 1.02 + 1


def test_languages(spark, folder, con):
    rows = {r.doc_id: r for r in LLM_QUERIES["op4_language_id"](spark, folder).collect()}
    langs = dict(con.execute("SELECT doc_id, lang FROM documents WHERE length(text) > 100").fetchall())
    held = [i for i in langs if rows[i].held_out]
    right = sum(rows[i].lang_pred == langs[i] for i in held)
    assert held and right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_shards(spark, folder, texts):
    import zlib

    rows = LLM_QUERIES["op7_uniform_shards"](spark, folder).collect()
    slots = defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert {len(s) for s in slots.values()} <= {len(texts) // 16, len(texts) // 16 + 1} and set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_fingerprints(spark, folder, texts):
    import hashlib

    rows = {r.doc_id: r for r in LLM_QUERIES["op8_fingerprints"](spark, folder).collect()}
    ids = sorted(texts)
    sets = {}
    for i in ids:
        words = WORD.findall(texts[i])
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    by_text = defaultdict(set)
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, half = texts[i], len(texts[i]) // 2
        edited = text[: len(text) - half] + texts[after][:half]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        by_text[text].add(r.fingerprint)
        words = WORD.findall(edited)
        other = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
        exact = len(sets[i] & other) / max(1, len(sets[i] | other))
        assert abs(r.near_edited - exact) < 0.3
        assert abs(r.near_next - len(sets[i] & sets[after]) / max(1, len(sets[i] | sets[after]))) < 0.3
        if len(sets[i]) < 64:
            assert r.n_shingles == len(sets[i])
    assert all(len(f) == 1 for f in by_text.values())


def test_token_counts(spark, folder, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in LLM_QUERIES["op9_token_counts"](spark, folder).collect():
        n = len(own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 1024)


def base_counts(text: str) -> tuple:
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(runs)
    repeated = {j + k for j, run in enumerate(runs) if often[run] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def test_quality(spark, folder, texts, con):
    quality = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = LLM_QUERIES["op10_quality_rules"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == base_counts(texts[r.doc_id] or "")
        assert not (r.kept and r.base_failed)
        if quality.get(r.doc_id) == 1:
            assert r.kept or r.base_failed
