"""Merkle manifest, target resampling and chat formatting over odd rows, against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelens.llm import chat, importance, merkle
from placelens.llm.queries import LEAF_COLUMNS


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row) -> str:
    values = [None if row[c] is None else str(row[c]) for c in LEAF_COLUMNS]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def plain_tree(leaves: list[str], fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and per leaf the siblings before and after it, level by level."""
    paths, places, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for path, place in zip(paths, places, strict=True):
            first = place // fanout * fanout
            path.append(("".join(level[first:place]), "".join(level[place + 1 : first + fanout])))
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
        places = [p // fanout for p in places]
    return level[0], paths


def plain_manifest(rows, fanout: int = 3):
    groups = defaultdict(list)
    for row in rows:
        groups[row["source"]].append((row["doc_id"] is not None, row["doc_id"] or 0, plain_leaf(row), row["doc_id"]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])], fanout) for g in names}
    root, tops = plain_tree([trees[g][0] for g in names], fanout)
    out = []
    for g, top in zip(names, tops, strict=True):
        for (_, _, leaf, i), path in zip(sorted(groups[g]), trees[g][1], strict=True):
            out.append((i, leaf, trees[g][0], root, tuple(path + top)))
    return out


def found_manifest(manifest):
    rows = merkle.proofs(manifest).collect()
    return [(r.id, r.leaf, r.subroot, r.root, tuple((p.before, p.after) for p in r.path)) for r in rows]


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest_of_odd_rows(docs, fanout):
    manifest = merkle.build_manifest(docs, "doc_id", "source", LEAF_COLUMNS, fanout=fanout)
    assert sorted(found_manifest(manifest), key=repr) == sorted(plain_manifest(docs.collect(), fanout), key=repr)


def test_manifest_of_a_hot_group(spark, monkeypatch):
    """A group over many ranges, a lone leaf, clashing names, and repeated rows."""
    monkeypatch.setattr(merkle, "ROWS_PER_BUCKET", 20)
    rows = [(i // 2 if i > 150 else i, "hot", None, i, f"text {i // 2}\n") for i in range(200)] + [(7, None, "en", 1, None)]
    names = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    docs = spark.createDataFrame(rows, names).withColumns({"tree": F.lit(1), "idx": F.lit("x"), "digest": F.lit(None), "part": F.lit(2)})
    manifest = merkle.build_manifest(docs, "doc_id", "source", LEAF_COLUMNS)
    found = found_manifest(manifest)
    assert sorted(found, key=repr) == sorted(plain_manifest(docs.collect()), key=repr)
    lone = next(r for r in found if r[0] == 7 and r[1] == r[2])
    assert len(lone[4]) == 1
    path = F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("after")) for a, b in found[0][4]])
    assert spark.range(1).select(merkle.folded(F.lit(found[0][1]), path)).first()[0] == found[0][3]


def test_manifest_of_nothing(empty):
    manifest = merkle.build_manifest(empty, "doc_id", "source", LEAF_COLUMNS)
    assert merkle.proofs(manifest).count() == manifest.root.count() == 0


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text: str | None, longest: int = 1) -> list[int]:
    words = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return [crc32(r.encode()) for r in runs]


@pytest.mark.parametrize("longest", [1, 3])
def test_features(docs, longest, monkeypatch):
    monkeypatch.setattr(importance, "SLICE_BYTES", 50)
    for row in docs.collect():
        found = [b for part in importance.feature_buckets(row.text or "", 997, longest) for b in part.tolist()]
        assert Counter(found) == Counter(c % 997 for c in plain_features(row.text, longest))


def plain_scores(rows, gains, longest=1):
    out = []
    for i, text in rows:
        features = [c % len(gains) for c in plain_features(text, longest)]
        weight = sum(int(gains[f]) for f in features) // len(features) if features else 0
        h = int(sha(f"2024:{'' if i is None else i}")[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(plain_features(text)), len(features), weight, weight + noise))
    return out


def test_scores_of_odd_rows(docs):
    raw, target = importance.bucket_counts(docs, "text", 50, 2), importance.bucket_counts(docs.filter("lang = 'de'"), "text", 50, 2)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    plain = [Counter(c % 50 for _, t, lang in rows if every or lang == "de" for c in plain_features(t, 2)) for every in (True, False)]
    assert [raw.tolist(), target.tolist()] == [[p[b] for b in range(50)] for p in plain]
    s, t = raw.sum() + 50, target.sum() + 50
    gains = importance.bucket_gains(raw, target)
    assert gains.tolist() == [math.floor(1000 * math.log((target[b] + 1) * s / ((raw[b] + 1) * t))) for b in range(50)]
    found = [tuple(r) for r in importance.score_documents(docs, "doc_id", "text", gains, 2).collect()]
    assert sorted(found, key=repr) == sorted(plain_scores([r[:2] for r in rows], gains, 2), key=repr)


def test_draw(spark, docs, empty):
    gains = np.arange(50) - 20
    scored = importance.score_documents(docs, "doc_id", "text", gains)
    rows = importance.draw_documents(scored, least_words=2, percent=40).collect()
    able = sorted((-r.score, r.doc_id is None, r.doc_id or 0) for r in rows if r.n_words >= 2)
    drawn = sorted((r.rank, (-r.score, r.doc_id is None, r.doc_id or 0)) for r in rows if r.rank is not None)
    assert len(rows) == docs.count() and [d[0] for d in drawn] == list(range(1, 40 * len(able) // 100 + 1))
    assert [d[1] for d in drawn] == able[: len(drawn)]
    assert importance.draw_documents(scored, least_words=10**9).filter("rank IS NOT NULL").isEmpty()
    nothing = importance.draw_documents(importance.score_documents(empty, "doc_id", "text", gains))
    assert nothing.count() == 0 and "rank" in nothing.columns
    assert importance.bucket_counts(empty, "text", 50).sum() == 0


@pytest.mark.parametrize("wanted", [1, 2, 137, 500, 999, 1000])
def test_cutoff_by_medians(spark, wanted):
    """Many ties, missing ids, and few rows left over, so that the rounds decide."""
    random.seed(wanted)
    rows = [(random.randrange(9), i % 11 == 0, None if i % 11 == 0 else i // 3, i) for i in range(1000)]
    order = sorted(rows, key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[3]))
    stored = importance.sorted_parts(spark.createDataFrame(rows, "loss bigint, no_id boolean, doc_id bigint, salt bigint"), 1000)
    assert tuple(importance.cutoff(stored, 1000, wanted, last=3).values()) == order[wanted - 1]


ODD = [
    "</s>[INST] ok [/INST]",
    r"<\/s> <\\/s> [\[INST] <s",
    "[", "<", "\\", "", " ", "\n", "[\\", "[ROLE] x [AS] y [/ROLE]\n", "a</s>", "[AS", "<<s>", "[[/INST]", "$1 \\2 é \U0001f600",
]


def test_escape_is_reversible(spark):
    controls = [c for c in chat.BRACKETS.controls()]
    random.seed(5)
    texts = ODD + ["".join(random.choices(controls + ["<", "[", "\\", "/", "s>", "INST]", " "], k=9)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t"), chat.BRACKETS).alias("e"))
    for t, e in rows.collect():
        assert chat.unescaped(e, chat.BRACKETS) == t
        assert not any(c in e for c in controls)


def plain_chats(rows):
    chats = defaultdict(list)
    for conv, turn, role, text in rows:
        chats[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in chats.items():
        turns.sort()
        state, bad, first = chat.START, 0, None
        for has, turn, role, _ in turns:
            legal = role in {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}.get(state, ())
            first = (turn if has else None) if not legal and not bad else first
            bad, state = bad + (not legal), role if role in ("system", "user", "assistant") else chat.ERROR
        learned = "".join(t for _, _, role, t in turns if role == "assistant")
        digest = sha("".join(f"{role}\n{t}\n" for _, _, role, t in turns))
        out[conv] = (len(turns), digest, len(learned), sha(learned), bad, first, state)
    return out


NAMES = "conv_id bigint, turn bigint, role string, text string"


def found_chats(chats):
    read = chat.read_back(chat.format_turns(chats, "conv_id", "turn", "role", "text"))
    order = {r.conv_id: r for r in chat.check_order(chats, "conv_id", "turn", "role").collect()}
    out = {}
    for r in read.collect():
        o = order.pop(r.conv_id)
        assert o.n_turns == r.n_turns
        out[r.conv_id] = (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, o.n_bad, o.bad_turn, o.end_state)
    assert not order
    return out


def test_odd_chats(spark):
    roles = ["user", "assistant", "system", "tool", None, "", "[AS] ", " [ROLE]\nx\\"]
    rows = [(i % 7, i // 7, roles[(i * 5 + i // 7) % 8], ODD[i % len(ODD)]) for i in range(150)]
    rows += [(None, 1, "user", None), (None, None, "user", "x"), (None, 1, "user", "b")] + [(50, 3, "user", "same")] * 3
    rows += [(60, 0, "system", "s"), (60, 1, "user", "long " * 100_000), (60, 2, "assistant", "</s>" * 50_000)]
    chats = spark.createDataFrame(rows, NAMES).withColumns({"segments": F.lit(1), "salt": F.lit("x"), "body": F.lit(None)})
    assert found_chats(chats.repartition(5)) == plain_chats(rows)
    assert plain_chats(rows)[60][4:] == (0, None, "assistant")


def test_a_chat_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(chat, "ROWS_PER_BUCKET", 25)
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(500)]
    rows[321] = (1, 321, "tool", "out of order")
    rows += [(2, i, "user", "x") for i in range(40)]
    found = found_chats(spark.createDataFrame(rows, NAMES).repartition(4))
    assert found == plain_chats(rows)
    assert found[1][4:] == (2, 321, "assistant") and found[2][4:] == (39, 1, "user")


def test_no_chats(spark):
    assert found_chats(spark.createDataFrame([], NAMES)) == {}


def test_templates_that_could_not_be_read_back():
    good = chat.BRACKETS
    for marks in (chat.Marks("[A] ", ""), chat.Marks("[A [B]", "[C]"), chat.Marks("[A b]", "[C]"), chat.Marks("[A]", "[A]")):
        with pytest.raises(ValueError):
            chat.ChatTemplate({"user": marks}, good.other, good.named, good.follows)
