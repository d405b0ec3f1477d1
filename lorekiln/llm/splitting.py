"""Cutting oversized texts at natural boundaries, with overlap.

Method: lexical cohesion. The similarity of the words in a block before and a block after each possible cut is a curve
along the text; its valleys mark changes of topic. Within each size window the cut with the deepest valley is taken, the
next piece starts the overlap before it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.llm.arrow_rows import flat_map

#: A run of letters, digits and underscores, or any other single character that is not Unicode white space (which U+001C to
#: U+001F are not, though Python's \s takes them so).
TOKEN = re.compile(r"\w+|[^\w\s]|[\x1c-\x1f]")
#: Tokens of each of the two compared blocks.
BLOCK = 60
#: What a boundary is worth beside its valley: a paragraph or heading, a line, the end of a sentence; inside code less.
PARAGRAPH, LINE, SENTENCE, IN_CODE = 0.30, 0.12, 0.0, -0.6
_SENTENCE_END = re.compile(r"[.!?…](?=\s)|[。！？]")
_LINE_END = re.compile(r"\r\n|\n|\r")
_FENCE = re.compile(r"^[ \t]*(?:```|~~~)|\\(?:begin|end)\{(?:verbatim|lstlisting|minted)\}|</?pre\b")


def count_tokens(text: str | None) -> int:
    return 0 if text is None else len(TOKEN.findall(text))


def _boundaries(text: str, starts: list[int]) -> dict[int, float]:
    """Token index -> worth of a cut in front of that token."""
    worth: dict[int, float] = {}

    def offer(at: int, w: float) -> None:
        i = bisect_left(starts, at)
        if 0 < i < len(starts):
            worth[i] = max(worth.get(i, -1.0), w)

    for m in _SENTENCE_END.finditer(text):
        offer(m.end(), SENTENCE)
    code, begin = False, 0
    spans: list[tuple[int, int]] = []
    opened = 0
    for m in [*_LINE_END.finditer(text), None]:
        end = m.start() if m else len(text)
        line = text[begin:end]
        if _FENCE.search(line):
            if code:
                spans.append((opened, end))
            else:
                opened = begin
            code = not code
        after = m.end() if m else end
        blank = not line.strip()
        heading = line.lstrip().startswith(("#", "==", "\\section", "\\subsection"))
        if heading and not code:
            offer(begin, PARAGRAPH)
        offer(after, PARAGRAPH if blank else LINE)
        begin = after
    for a, b in spans:
        for i in range(bisect_right(starts, a), bisect_left(starts, b)):
            if i in worth:
                worth[i] += IN_CODE
    return worth


def _depths(words: list[str], cuts: list[int]) -> list[float]:
    """Depth of the similarity valley at each cut: how far the curve rises to its nearest peak on either side."""
    sims = []
    n = len(words)
    left: Counter = Counter()
    right: Counter = Counter()
    la = lb = ra = rb = 0  # the windows' current ends
    for c in cuts:
        a, b = max(0, c - BLOCK), min(n, c + BLOCK)
        if a >= lb:
            left, la, lb = Counter(), a, a
        for i in range(lb, c):
            left[words[i]] += 1
        for i in range(la, a):
            left[words[i]] -= 1
        la, lb = a, c
        if c >= rb:
            right, ra, rb = Counter(), c, c
        for i in range(rb, b):
            right[words[i]] += 1
        for i in range(ra, c):
            right[words[i]] -= 1
        ra, rb = c, b
        dot = sum(v * right[w] for w, v in left.items() if v and w in right)
        norm = math.sqrt(sum(v * v for v in left.values()) * sum(v * v for v in right.values()))
        sims.append(dot / norm if norm else 0.0)
    m = len(sims)
    up_left, up_right = [0.0] * m, [0.0] * m
    for i in range(m):  # the climb ends where the curve turns down
        up_left[i] = up_left[i - 1] if i and sims[i - 1] >= sims[i] else sims[i]
        j = m - 1 - i
        up_right[j] = up_right[j + 1] if i and sims[j + 1] >= sims[j] else sims[j]
    return [up_left[i] + up_right[i] - 2 * sims[i] for i in range(m)]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces as (first character, end character, tokens), each of at most `limit` tokens.

    Consecutive pieces share exactly `overlap` tokens (fewer only if limit <= overlap, where limit - 1 takes its place); a
    text within the limit is one piece. The cut of a piece is the natural boundary with the deepest valley in the second
    half of its window, else anywhere beyond the overlap, else, where there is no natural boundary, the full limit.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    spans = [m.span() for m in TOKEN.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [(0, len(text), n)]
    overlap = max(0, min(overlap, limit - 1))
    starts = [a for a, _ in spans]
    worth = _boundaries(text, starts)
    cuts = sorted(worth)
    words = [text[a:b].lower() for a, b in spans]
    score = {c: d + worth[c] for c, d in zip(cuts, _depths(words, cuts))}
    pieces = []
    first = 0
    while n - first > limit:
        for low in (first + max(overlap, limit // 2), first + overlap):
            inside = cuts[bisect_right(cuts, low) : bisect_right(cuts, first + limit)]
            if inside:
                cut = max(inside, key=lambda c: (score[c], c))
                break
        else:
            cut = first + limit
        pieces.append((spans[first][0], spans[cut - 1][1], cut - first))
        first = cut - overlap
    pieces.append((spans[first][0], spans[n - 1][1], n - first))
    return pieces


def split_oversized(chunks: DataFrame, config: DataFrame, only_oversized: bool = False) -> DataFrame:
    """chunk_id, document_id, section_path, tier, piece, pieces, tokens, content: every chunk, the oversized ones cut.

    The limit is that of the chunk's tier; a tier without one leaves its chunks whole (pieces = 1), as does a null content,
    which has 0 tokens. Repeated rows count once. With only_oversized, chunks within their limit are left out. `config` is
    a table of tiers (a row each, the smallest limit where a tier repeats) and is joined as the optimizer sees fit.
    """
    limits = config.groupBy(F.col("tier").alias("__tier")).agg(F.min("max_tokens").alias("__max"), F.max("overlap_tokens").alias("__overlap"))
    keep = ["chunk_id", "document_id", "section_path", "tier"]
    rows = chunks.select(*keep, "content").join(limits, F.col("tier") == F.col("__tier"), "inner" if only_oversized else "left")
    if only_oversized:
        rows = rows.where(F.length("content") > F.col("__max"))  # a token has a character at least
    else:
        rows = rows.distinct()

    def make():
        def cut(chunk_id, document_id, section_path, tier, content, limit, overlap):
            n = count_tokens(content)
            if content is None or limit is None or n <= limit:
                return [] if only_oversized else [(chunk_id, document_id, section_path, tier, 1, 1, n, content)]
            pieces = split_text(content, limit, overlap or 0)
            return [(chunk_id, document_id, section_path, tier, i, len(pieces), k, content[a:b]) for i, (a, b, k) in enumerate(pieces, 1)]

        return cut

    schema = "chunk_id string, document_id string, section_path string, tier string, piece int, pieces int, tokens int, content string"
    out = flat_map(rows.select(*keep, "content", "__max", "__overlap"), make, schema)
    return out.distinct() if only_oversized else out
