"""Token counts by a linear longest-match automaton.

A word is a run of characters other than space and tab to carriage return, written with one leading space. Its greedy
word pieces are, from the left, always the longest token of the vocabulary that matches. The automaton is a trie of the
vocabulary whose nodes hold a failure link (the node for what is left over once the longest tokens are taken off) and
the number of tokens taken off on the way, so a word's piece count is found in one pass and no piece is ever built.

Edge cases: a null text counts zero tokens, as does an empty one; every byte is a token, so nothing is unknown. Whole
texts are counted. Repeated rows give repeated results, an empty table gives an empty table, and other columns are
ignored unless kept.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.common import Bounded, map_texts, tiktoken_ranks, vocabulary_path

VOCABULARY = "byte_bpe_50k.tiktoken"
FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])


class LongestMatch:
    """Trie with failure links and popped-token counts over a set of byte strings."""

    def __init__(self, tokens: Iterable[bytes]):
        child: list[dict[int, int]] = [{}]
        final = [False]
        for token in tokens:
            at = 0
            for b in token:
                step = child[at].get(b)
                if step is None:
                    step = child[at][b] = len(child)
                    child.append({})
                    final.append(False)
                at = step
            final[at] = at != 0
        if any(b not in child[0] or not final[child[0][b]] for b in range(256)):
            raise ValueError("every byte must be a token")
        n = len(child)
        fail, pops = [0] * n, [0] * n
        queue = deque([0])
        while queue:
            v = queue.popleft()
            for b, u in child[v].items():
                queue.append(u)
                if final[u]:
                    # All of it is one token: what is left over is nothing.
                    fail[u], pops[u] = 0, 1
                    continue
                # Otherwise the parent's pieces go first, then what is left over is followed by b.
                z, taken = fail[v], pops[v]
                while b not in child[z]:
                    taken += pops[z]
                    z = fail[z]
                fail[u], pops[u] = child[z][b], taken
        self.child, self.fail, self.pops = child, fail, pops

    def count(self, word: bytes) -> int:
        """The number of greedy longest pieces of a word."""
        child, fail, pops = self.child, self.fail, self.pops
        at = n = 0
        for b in word:
            while (step := child[at].get(b)) is None:
                n += pops[at]
                at = fail[at]
            at = step
        while at:
            n += pops[at]
            at = fail[at]
        return n


def count_tokens(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), vocabulary: str | None = None) -> DataFrame:
    """Words and word pieces of each row's text."""

    def make():
        automaton = LongestMatch(tiktoken_ranks(vocabulary or vocabulary_path(VOCABULARY)))
        known = Bounded(lambda w: automaton.count(b" " + w), 500_000)

        def work(texts):
            words, tokens = [], []
            for x in texts:
                found = (x or "").encode("utf-8", "surrogatepass").split()
                words.append(len(found))
                tokens.append(sum(n * known[w] for w, n in Counter(found).items()))
            return {"n_words": words, "n_tokens": tokens}

        return work

    return map_texts(df, text, make, FIELDS, keep)
