from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from helixframe.llm import conversations, pieces, spelling
from helixframe.llm.common import staged

TURNS = "conv_id long, turn long, role string, text string, ck string, seg long, pos long"


# --- spelling variants ---


def _one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _variants(words: dict[str, int]) -> set[tuple]:
    near = {w: [o for o in words if _one_edit(w, o)] for w in words}
    best = {w: min(os, key=lambda o: (-words[o], o)) for w, os in near.items() if os}
    form = {w: b for w, b in best.items() if words[b] >= 2 * words[w]}

    def root(w: str) -> str:
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


@pytest.mark.parametrize("letters", ["ab", "abcé", "a"])
def test_variants_equal_all_pairs(spark, letters):
    r = random.Random(len(letters))
    words = {"".join(r.choice(letters) for _ in range(r.randint(5, 9))): r.choice([3, 4, 6, 9, 20, 50, 100]) for _ in range(160)}
    found = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {tuple(x) for x in found} == _variants(words) and len(found) == len(words)


def test_every_edit_meets_in_a_key():
    r = random.Random(3)
    words = {"".join(r.choice("abcd") for _ in range(r.randint(5, 12))) for _ in range(300)}
    for w in list(words):
        k = r.randrange(len(w))
        words |= {w[:k] + r.choice("abcd") + w[k:], w[:k] + r.choice("abcd") + w[k + 1 :]} | ({w[:k] + w[k + 1 :]} if len(w) > 5 else set())
    grams = Counter(w[k : k + 2] for w in words for k in range(len(w) - 1))
    ranks = {g: k for k, (_, g) in enumerate(sorted((n, g) for g, n in grams.items()))}
    keys = {w: spelling.keys_of(w, ranks) for w in words}
    for a, b in itertools.combinations(sorted(words, key=len), 2):
        if _one_edit(a, b):
            assert keys[a][0] & keys[b][len(b) - len(a)], (a, b)


def test_forms_lead_to_roots(spark):
    chain = [("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 24), ("abbbb", 50), ("zzzzz", 3)]
    found = {r.word: (r.form, r.root, r.n_near) for r in spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert found["aaaaa"] == ("aaaab", "abbbb", 1) and found["abbbb"] == (None, "abbbb", 1) and found["zzzzz"] == (None, "zzzzz", 0)
    with pytest.raises(ValueError, match="four code points"):
        spelling.near_words(spark.createDataFrame([("abc", 3)], "word string, n long"))


def test_words_of_odd_rows(spark, odd, odd_rows, empty):
    want: Counter = Counter()
    for i, text, *_ in odd_rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run] += 1
    want.pop("", None)
    assert {r.word: r.n for r in spelling.word_counts(odd, typo_every=3).collect()} == dict(want)
    assert spelling.spelling_variants(odd).count() == sum(n >= 3 and len(w) >= 5 for w, n in _plain_counts(odd_rows).items())
    assert spelling.spelling_variants(empty).collect() == []


def _plain_counts(rows) -> Counter:
    return Counter(w for _, text, *_ in rows for w in re.findall("[A-Za-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


# --- conversation structure ---


def _order(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))


def _damage(rows: list[tuple], every: int) -> list[tuple]:
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % every
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def _repair(rows: list[tuple]) -> tuple:
    """All ways of editing a conversation, cheapest first, as plain recursion."""
    rows = _order(rows)
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None

    def grow(k: int, cost: int, audit: str, lines: list[tuple[str, str]], free: int) -> None:
        nonlocal best
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(x[0][:1] for x in lines)):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
        if free:
            for role in ("user", "assistant"):
                grow(k, cost + 3, audit + "I", [*lines, (role, "")], free - 1)
        if k < len(rows):
            _, _, role, text = rows[k]
            grow(k + 1, cost + 4, audit + "D", lines, 2)
            if faults[k] not in ("blank", "duplicate"):
                more = 3 * (faults[k] == "truncated")
                grow(k + 1, cost + more, audit + "K", [*lines, (role, text)], 2)
                for new in ("user", "assistant"):
                    grow(k + 1, cost + 3 + more, audit + "R", [*lines, (new, text)], 2)

    grow(0, 0, "", [], 2)
    x = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(x))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest()
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, best[0], best[1], digest


def _conversations(seed: int) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for c in [*range(24), None]:
        for t in range(r.randint(1, 4)):
            role = r.choice(["user", "assistant", "system", "user", "assistant", None, "tool", ""])
            out.append((c, r.choice([t, t, t, 2 * t, None]), role, r.choice(["Yes.", "No", "No", " \n", "", None, "Why? ", "x" * 50 + "!"])))
    return out


FOUND = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("bits", [(12, 5), (0, 1)])
def test_repairs_equal_all_edits(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "SEGMENT_BITS", bits[0])
    monkeypatch.setattr(conversations, "FAN_BITS", bits[1])
    rows = _conversations(7)
    found = conversations.conversation_repair(spark.createDataFrame([(*x, "c", 1, 2) for x in rows], TURNS), every=9).collect()
    bad = _damage(rows, 9)
    want = {c: _repair([x for x in bad if x[0] == c]) for c in {x[0] for x in rows}}
    assert len(found) == len(want) and {r.conv_id: tuple(r[c] for c in FOUND) for r in found} == want


def test_a_long_conversation_is_cut_into_segments(spark, monkeypatch):
    r = random.Random(1)
    rows = [(1, t, r.choice(["user", "assistant", "system"]), f"Turn {t}{r.choice('.. ')}", "c", 1, 2) for t in range(3000)] + [(2, 0, "user", "Hi.", "c", 1, 2)]
    df = spark.createDataFrame(rows, TURNS)
    whole = {x.conv_id: tuple(x[c] for c in FOUND) for x in conversations.conversation_repair(df).collect()}
    monkeypatch.setattr(conversations, "SEGMENT_BITS", 5)
    monkeypatch.setattr(conversations, "FAN_BITS", 2)
    leaves = conversations.segments(conversations.with_faults(conversations.in_order(df)))
    assert leaves.where("ck = '=1'").count() >= 3000 // 32
    assert {x.conv_id: tuple(x[c] for c in FOUND) for x in conversations.conversation_repair(df).collect()} == whole
    # the turns themselves: good roles in every conversation
    _, repaired = conversations.repair(df.select("conv_id", "turn", "role", "text"))
    initials = "".join(x.role[0] for x in repaired.where("ck = '=1'").orderBy("pos", "sub").collect())
    assert re.fullmatch("s?(ua)+", initials)


def test_conversations_that_are_empty(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversations.conversation_repair(empty).collect() == []
    gone = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    found = conversations.conversation_repair(spark.createDataFrame([(c, 0, "user", "Hi.", "c", 1, 2) for c in gone], TURNS)).collect()
    assert {tuple(r[c] for c in FOUND) for r in found} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(found) == 2


def test_products_are_associative():
    r = random.Random(2)
    for _ in range(200):
        a, b, c = (conversations.turn_matrix(r.choice(["u", "a", "s", "", "x"]), r.randrange(4)) for _ in range(3))
        assert conversations.product(conversations.product(a, b), c) == conversations.product(a, conversations.product(b, c))


# --- encoding and decoding ---


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def run(text: str | None) -> tuple:
        ids = sp.encode(text or "", add_eos=True)
        return ids, sp.decode(ids)

    return run


@pytest.mark.parametrize("block", [1, 5000, pieces.BLOCK_CHARS])
def test_pieces_equal_the_library(spark, odd, odd_rows, library, block):
    found = pieces.encoded(odd, with_ids=True, block_chars=block, most_chunks=50 if block == 5000 else pieces.MOST_CHUNKS).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter((i, len(ids), sha(" ".join(map(str, ids))), sha(text), tuple(ids), text) for i, (ids, text) in ((x[0], library(x[1])) for x in odd_rows))
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in found) == want
    assert sum(r.n_late for r in found) == 0


def test_all_chunks_of_files_are_answered(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    folder = staged(docs, "docs")
    assert {r.n_late for r in pieces.encoded(folder, block_chars=20_000).collect()} == {0}


def test_pieces_of_strange_texts(spark, library):
    r = random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", "▁", "é", "日", "\0", "\t", "the", "ing", "</s>", "😀", "\r", "\x85", "ﬁ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(400)]
    found = pieces.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    assert {x.doc_id: (x.ids, x.decoded) for x in found} == dict(enumerate(map(library, texts)))


def test_models_without_cuts_take_whole_texts(library):
    import public_tokenizers

    tool = pieces.Chunks(public_tokenizers.path("piece_bpe_32k.model"))
    tool.cuts = False
    assert tool.split("a b\nc") == ["a b\nc"] and tool.segment(["a b\nc"])[0] == [library("a b\nc")[0][:-1]]


def test_blocks_without_answers_are_segmented_late(spark, odd, odd_rows, library):
    """Rows in a random order are cut in another way when they are read for the second time."""
    from pyspark.sql import functions as F

    mixed = odd.repartition(3).orderBy(F.rand())
    found = pieces.encoded(mixed, with_ids=True, block_chars=3000).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in found) == Counter((x[0], tuple(library(x[1])[0]), library(x[1])[1]) for x in odd_rows)


def test_pieces_of_no_rows(spark, empty):
    assert pieces.encoded(empty).collect() == []
