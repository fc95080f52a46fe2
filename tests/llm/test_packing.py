import random
import zlib
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

from tablelens.llm.packing import (Runs, WordIds, fullest, minimum_bin_slack, op10_best_fit_packing, pack_documents,
                                   sequences, tokenizer_path)

from .conftest import SMALL


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def pieces(tokenizer, rows, size):
    out = []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), size)):
            own = ids[at:at + size]
            out.append((i, k, at, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
    return sorted(out, key=repr)


def check_places(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_smallest_table(spark, small, tokenizer):
    rows = op10_best_fit_packing(spark, SMALL).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == pieces(
        tokenizer, [(i, t) for i, t, *_ in small], 4096)
    assert check_places(rows, 4096) == -(-sum(r.length for r in rows) // 4096)


def test_odd_rows(odd, none, tokenizer):
    rows = pack_documents(odd, size=50).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == pieces(
        tokenizer, [(r.doc_id, r.text) for r in odd.collect()], 50)
    check_places(rows, 50)
    assert pack_documents(none).count() == 0


def test_special_tokens_in_capitals(tokenizer):
    for text in ("a <|STARTOFTEXT|> b", "<|EndOfText|> c", "x<|ENDOFTEXT|>y <|StartOfText|>", "Plain Words, HERE."):
        got = WordIds(tokenizer_path()).encode([text, "other words"])
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "other words")]
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == want


def test_ids_equal_the_tokenizers(tokenizer):
    """Texts of odd characters, by a cache so small that it loses words all the time."""
    rng = random.Random(12)
    parts = ["don't", "I'LL", "'s", "x's'", "we've!!", "a.b,c", "1234", "5th", "$$$", "***word***", "über", "ÉCOLE,", "ñ!", "×", "3×4", "a÷b",
             "İstanbul", "ıI", "ﬁn", "e\u0301", "e\u0301!", "\u0301x", "Å", "ſs", "ŉ", "ǅ", "ß.", "日本語", "текст,", "𝔘𝔫𝔦", "—", "“q”", "’s", "\xa0",
             "\u2009", "\x85", "\x1c", "\x00", "\x7f", "\u200b", "<|", "|>", "<|endoftext", "🙂", "²", "½", "Ⅷ", "_", "a_b", "İ!", "K"]
    blanks = [" ", "", "\n", "  ", "\t", "\r\n", " ' "]
    texts = ["".join(rng.choice(parts) + rng.choice(blanks) for _ in range(rng.randint(1, 12))) for _ in range(6000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x24F), rng.randint(0x300, 0x36F)])) for _ in range(20))
              for _ in range(2000)]
    small = WordIds(tokenizer_path(), 300)
    got = [x for i in range(0, len(texts), 50) for x in small.encode(texts[i:i + 50])]
    assert len(small.units) <= 300 and len(small.words) <= 300
    texts += ["", None, "'", "''s", "x's't're'd", "'s", "'", "'l", "it'll'", "\n", "'Re'VE"]
    got += small.encode(texts[-11:])
    for text, own in zip(texts, got, strict=True):
        assert np.frombuffer(own, dtype="<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_round_trip(odd, tokenizer):
    whole = pack_documents(odd, size=64, keep_ids=True)
    made = {r.sequence_id: r.ids for r in sequences(whole).collect()}
    back = {}
    for r in whole.collect():
        own = made[r.sequence_id][r.offset:r.offset + r.length]
        assert own == r.ids
        back.setdefault(r.doc_id, {})[r.start] = own
    for r in odd.where("doc_id in (5, 14, 15, 18)").collect():
        ids = [x for _, own in sorted(back[r.doc_id].items()) for x in own]
        assert ids == [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]


def test_fullest_choice():
    rng = random.Random(4)
    for _ in range(60):
        size = rng.randint(10, 40)
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 9))]
        left = np.zeros(size + 1, dtype=np.int64)
        for x in lengths:
            left[x] += 1
        anchor = max(lengths)
        chosen = fullest(left, anchor, size)
        assert all(left[x] >= n for x, n in chosen.items()) and chosen[anchor] >= 1
        rest = list(lengths)
        rest.remove(anchor)
        best = max(anchor + sum(c) for k in range(len(rest) + 1) for c in combinations(rest, k) if anchor + sum(c) <= size)
        assert sum(x * n for x, n in chosen.items()) == best


def test_plan_deals_every_piece_once():
    rng = random.Random(9)
    counts = Counter(rng.choice([7, 13, 50, 64, rng.randint(1, 64)]) for _ in range(5000))
    plan = minimum_bin_slack(counts, 64)
    filled = Counter()
    for length, total in counts.items():
        first = plan.first[length]
        for rank in range(total):
            run = np.searchsorted(first, rank, side="right") - 1
            past = rank - first[run]
            filled[plan.sequence[length][run] + past // plan.uses[length][run]] += length
    assert set(filled) == set(range(plan.sequences)) and max(filled.values()) <= 64
    assert plan.sequences <= 1.02 * -(-sum(x * n for x, n in counts.items()) // 64)


def test_runs_deal_every_piece_once_in_order():
    rng = random.Random(10)
    counts = Counter(rng.choice([7, 13, 50, 64, rng.randint(1, 64)]) for _ in range(3000))
    plan = minimum_bin_slack(counts, 64)
    runs = Runs.of(plan)
    rows = [r for own in runs.slots(np.arange(plan.sequences)) for r in zip(*(c.tolist() for c in own), strict=True)]
    assert sorted((n, rank) for n, rank, *_ in rows) == sorted((n, rank) for n, c in counts.items() for rank in range(c))
    by = {}
    for n, _, made, offset in rows:
        by.setdefault(made, []).append((offset, n))
    assert set(by) == set(range(plan.sequences))
    for own in by.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 64

    def way(made):
        run = int(np.searchsorted(runs.first, made, side="right")) - 1
        return Fraction(int(2 * (made - runs.first[run]) + 1), int(2 * runs.times[run])), run

    for length in counts:
        dealt = [way(made) for n, _, made, _ in sorted(rows) if n == length]
        assert dealt == sorted(dealt)
