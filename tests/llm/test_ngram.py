import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from careline.llm.common import fold_of
from careline.llm.ngram import packed, planed, score_corpus, unpacked, unplaned


def tokens_of(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", fold), None]


class Model:
    """Counts in dictionaries; probabilities by recursion, scores by a walk over states and failure arcs."""

    def __init__(self, train):
        self.counts = Counter()
        for tokens in train:
            for k in range(3):
                self.counts.update(tuple(tokens[i:i + k + 1]) for i in range(len(tokens) - k))
        words = {g: c for g, c in self.counts.items() if len(g) == 1}
        self.n, self.v = sum(words.values()), len(words)
        singles, mass = Counter(), Counter()
        for g, c in self.counts.items():
            if len(g) > 1:
                key = len(g), self.counts[g[:-1]].bit_length()
                mass[key] += c
                singles[key] += c == 1
        self.kept = {k: (singles[k] + 1) / (mass[k] + 1) for k in mass}

    def back(self, history):
        return self.kept.get((len(history) + 1, self.counts[history].bit_length()), 1.0)

    def p(self, history, word):
        if not history:
            return (self.counts[word,] + 1) / (self.n + self.v + 1)
        shorter = self.p(history[1:], word)
        if not self.counts[history]:
            return shorter
        back = self.back(history)
        return (1 - back) * self.counts[*history, word] / self.counts[history] + back * shorter

    def score(self, tokens):
        state, score = (), 0.0
        for w in tokens:
            while state and not self.counts[*state, w]:
                score += math.log10(self.back(state))
                state = state[1:]
            score += math.log10(self.p(state, w))
            state = (*state, w)[-2:] if self.counts[w,] else ()
        return score


def brute(rows, held):
    model = Model([tokens_of(t) for i, t in rows if i not in held])
    out = []
    for i, text in rows:
        tokens = tokens_of(text)
        base = sum(math.log10(model.p((), w)) for w in tokens)
        plain = sum(math.log10(model.p(tuple(tokens[max(0, k - 2):k]), w)) for k, w in enumerate(tokens))
        score = model.score(tokens)
        assert score == pytest.approx(plain, rel=1e-9)
        out.append((i, i in held, len(tokens), sum(model.counts[w,] > 0 for w in tokens), model.n,
                    base, score))
    return out


@pytest.mark.parametrize("block, entries", [(1_500_000, 3_000_000), (37, 50), (1, 400)])
def test_against_brute_force(docs_of, block, entries):
    rng = random.Random(3)
    words = ["The", "of", "É", *(f"w{i}" for i in range(30))]
    rows = [(i, rng.choice([" ", "\n\t"]).join(rng.choice(words) for _ in range(rng.randint(0, 90))))
            for i in range(80)]
    rows += [(100, None), (101, ""), (102, rows[5][1]), (103, "new words only here"),
             (104, "The of " * 300)]
    docs, learn = docs_of(rows), fold_of(F.col("doc_id"), 7) != 2
    held = {r.doc_id for r in docs.filter(~learn).collect()}
    got = {r.doc_id: r for r in score_corpus(docs, learn, block, entries).collect()}
    assert len(held) > 5 and len(got) == len(rows)
    for i, out, n, known, total, base, score in brute(rows, held):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=1e-9)


def test_probabilities_sum_to_one():
    """Over the known words and one unknown word, in every state."""
    model = Model([tokens_of(t) for t in ["a b a c", "b a", "c c a b", "a b a c"]])
    words = [*(g[0] for g in model.counts if len(g) == 1), "unknown"]
    states = [g for g in model.counts if len(g) < 3 and g[-1] is not None]
    assert len(states) == 8
    for state in [(), *states]:
        assert sum(model.p(state, w) for w in words) == pytest.approx(1)


def test_a_text_seen_twice_stands_out(docs_of):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(60))) for i in range(200)]
    rows += [(300, rows[0][1]), (301, rows[0][1])]
    got = {r.doc_id: r.score - r.base_score for r in score_corpus(docs_of(rows), F.lit(True)).collect()}
    assert got[0] > max(v for i, v in got.items() if i not in (0, 300, 301)) + 40


def test_odd_rows(docs_of):
    learn = fold_of(F.col("doc_id"), 7) != 2
    rows = [(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b"), (2**60 + 1, "")]
    got = score_corpus(docs_of(rows), learn).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert score_corpus(docs_of([]), learn).count() == 0


def test_packing():
    import numpy as np
    numbers = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64))
    assert (unpacked(packed(numbers)) == numbers).all()
    assert (unplaned(planed(np.array([3, 0, 5, 1]))) == [3, 0, 5, 1]).all()
    assert len(unpacked(packed(numbers[:0]))) == 0
