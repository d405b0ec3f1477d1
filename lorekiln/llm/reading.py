"""Reading level of each document: regularised ordinal regression calibrated to graded texts.

Features describe the prose alone: lexical diversity, word rarity in the corpus, connectives, a proxy of clause depth and
lengths. Sentence features enter as medians over the sentences, so one quoted or odd sentence does not move a document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from statistics import median

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.llm.arrow_rows import flat_map
from lorekiln.session import settled

#: Graded documents the regression is fitted on, at most; those with the lowest hash of their id. Scoring covers all.
FIT_ROWS = 20_000
#: Weight of the ridge on the standardised coefficients.
RIDGE = 1.0
#: A word in this share of documents or more counts as frequent; there are at most (words per document) / FREQUENT of them.
FREQUENT = 1 / 200

FEATURES = ("sentence_words", "word_chars", "long_words", "diversity", "connectives", "clauses", "log_words", "rarity")

#: Words that join clauses or subordinate one to another, by language.
CONNECTIVES = frozenset(
    """because although unless whereas while since if when once before after until which that as and but or so therefore however
    thus hence insofar notwithstanding albeit whereby therein moreover consequently furthermore correspondingly conversely only
    weil obwohl wenn während bevor nachdem sobald damit dass daß denn aber und oder sondern sofern wenngleich insofern dennoch
    deshalb folglich mithin gleichwohl indem nur welche welcher welches die der das
    parce que quoique si quand lorsque comme mais ou et donc ainsi cependant laquelle lequel dans mesure où qui dont toutefois
    porque aunque cuando como pero o y si mientras antes después hasta que cual medida así embargo pues sino
    もし 次に しかし""".split()
)

#: Function words by which the language of the prose is told.
LANGUAGES = {
    "en": frozenset("the of to and is in a that for you with it on as this".split()),
    "de": frozenset("der die das und ist nicht ein eine den dem zu mit auf von für".split()),
    "fr": frozenset("le la les des un une et est de du dans que qui pour à".split()),
    "es": frozenset("el la los las de que y en un una es por con del para".split()),
}

_FENCE = re.compile(r"^\s{0,3}(```|~~~)")
_BLOCK_OPEN = re.compile(r"\\begin\{(verbatim|lstlisting|minted|equation|align|tabular)|<(pre|script|style|syntaxhighlight|source)\b", re.I)
_BLOCK_SHUT = re.compile(r"\\end\{(verbatim|lstlisting|minted|equation|align|tabular)|</(pre|script|style|syntaxhighlight|source)>", re.I)
_NO_PROSE = re.compile(
    r"""^(?:\#{1,6}\s|={1,6}\s.*=|[=\-~*_\s|:+.]+$|\$\s|\||\s*</?\w[^>]*>\s*$|@\w+|[\w.\-\[\]]+\s*[=:]\s*\S*$|[\w.\-]+:$|.*[{};]\s*$|//|\#|import\s|package\s)""", re.X
)
_QUOTED = re.compile(r"""^\s*(?:>|["“„«»‚'‘].*["”“»«’']\s*\.?\s*$)""")
_INNER_QUOTE = re.compile(r"[\"“„«][^\"“”„«»]{40,}[\"”“»]")
_QUOTE_MARK = re.compile("[\"“„«]")
_BULLET = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_NAMES = re.compile(r"`[^`]*`|\b(?=\w)(?:https?://\S+|\w*[a-z0-9][A-Z]\w*|\w+(?:[.\-_/]\w+)*[._/]\w+\S*)")
# these begin with the character they look for, which lets the search skip to it
_HUMP = re.compile(r"[A-Z](?<=[a-z0-9].)")
_JOINT = re.compile(r"[._/](?<=\w.)(?=\w)")
_ENDS, _AFTER_END = frozenset(".!?…。！？:,"), " \t\u3000\"'”’»)]*_`"
_INDENT = re.compile(r" {4}|\t")
_CLAUSE = re.compile("[,;—、]")
_END = re.compile(r"[.!?…]\s+")
_END_CJK = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
_WORD = re.compile(r"[^\W\d_]+")
_ASCII_WORD = re.compile(r"[a-z]+")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")


def words_of(sentence: str) -> list[str]:
    """Lower-cased words; scripts without spaces count two characters a word."""
    if sentence.isascii():
        return _ASCII_WORD.findall(sentence.lower())
    words = _WORD.findall(sentence.lower())
    if not _CJK.search(sentence):
        return words
    out = []
    for w in words:
        if _CJK.search(w):
            out += [w[i : i + 2] for i in range(0, len(w), 2)]
        else:
            out.append(w)
    return out


def prose_sentences(text: str) -> list[str]:
    """Sentences of the running text, without code, settings, tables, headings and quoted passages."""
    return [s for s, _ in _prose(text)]


def _split(line: str) -> list[str]:
    """Parts between the white space after sentence marks; in other scripts full stops end a sentence without any."""
    if not line.isascii() and ("。" in line or "！" in line or "？" in line):
        return _END_CJK.split(line)
    out, at = [], 0
    for m in _END.finditer(line):
        out.append(line[at : m.start() + 1])
        at = m.end()
    out.append(line[at:])
    return out


def _prose(text: str) -> list[tuple[str, list[str]]]:
    lines: list[str] = []
    fence = block = False
    for raw in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if ("```" in raw or "~~~" in raw) and _FENCE.match(raw):
            fence = not fence
            continue
        if fence:
            continue
        if not block and ("\\" in raw or "<" in raw) and _BLOCK_OPEN.search(raw):
            block = not _BLOCK_SHUT.search(raw)
            continue
        if block:
            block = not _BLOCK_SHUT.search(raw)
            continue
        item = _BULLET.match(raw)
        line = raw[item.end() :] if item else raw
        if not item and _INDENT.match(raw):
            continue
        line = line.strip()
        if not line or _NO_PROSE.match(line) or _QUOTED.match(line):
            continue
        lines.append(_INNER_QUOTE.sub(" ", line) if ('"' in line or not line.isascii()) and _QUOTE_MARK.search(line) else line)
    out = []
    for line in lines:
        for s in _split(line):
            bare = s.rstrip(_AFTER_END)
            if not bare or bare[-1] not in _ENDS:
                continue
            named = "`" in s or "://" in s or _JOINT.search(s) or _HUMP.search(s)
            plain = _NAMES.sub(" ", s) if named else s
            words = words_of(plain)
            if len(words) >= 2:
                out.append((plain, words))
    return out


def language_of(words: list[str] | Counter) -> str:
    """The language with most of its function words among `words`; `other` when fewer than one word in twenty is one."""
    counts = words if isinstance(words, Counter) else Counter(words)
    hits = {k: sum(counts[w] for w in v) for k, v in LANGUAGES.items()}
    best = max(hits, key=lambda k: (hits[k], k))
    return best if hits[best] * 20 > counts.total() else "other"


def moving_diversity(words: list[str], window: int = 40) -> float:
    """Mean number of different words in all windows of so many words, by the root of the window; short texts are one window."""
    n = len(words)
    if n <= window:
        return len(set(words)) / math.sqrt(n)
    last: dict[str, int] = {}
    total, final = 0, n - window
    for i, w in enumerate(words):
        # the windows in which this is the first of its kind begin after the one before it
        begin = last.get(w, -1) + 1
        last[w] = i
        if begin <= i - window:
            begin = i - window + 1
        end = i if i < final else final
        if end >= begin:
            total += end - begin + 1
    return total / (final + 1) / math.sqrt(window)


def sentence_features(text: str | None) -> tuple[str, list[float], list[str]] | None:
    """The language, the features but for rarity, and the distinct words; None for a text without prose."""
    sentences = _prose(text) if text else []
    if not sentences:
        return None
    per = []
    for s, w in sentences:
        n = len(w)
        sizes = list(map(len, w))
        joins = len([x for x in w if x in CONNECTIVES])
        long = len([k for k in sizes if k >= 10])
        per.append((n, sum(sizes) / n, long / n, joins / n, joins + len(_CLAUSE.findall(s))))
    words = [x for _, w in sentences for x in w]
    diversity = moving_diversity(words)
    mid = [median(c) for c in zip(*per)]
    values = [mid[0], mid[1], mid[2], diversity, mid[3], mid[4], math.log(1 + len(words))]
    counts = Counter(words)
    return language_of(counts), values, list(counts)


def prose_features(documents: DataFrame) -> DataFrame:
    """(doc_id, language, words, features) of each document with prose; words are its distinct words."""

    def make():
        def f(doc_id, text):
            found = sentence_features(text)
            return [] if found is None else [(doc_id, found[0], found[2], *map(float, found[1]))]

        return f

    names = ", ".join(f"{n} double" for n in FEATURES[:-1])
    return flat_map(documents.select("doc_id", "text"), make, f"doc_id bigint, language string, words array<string>, {names}", rows=128)


def word_rarity(features: DataFrame) -> DataFrame:
    """(doc_id, rarity): mean ln(documents / documents with the word) over a document's distinct words.

    Frequent words are few by construction, so they are broadcast; the others are joined by shuffle, where no word has
    more than a FREQUENT share of the documents, so no task is hot.
    """
    n = features.count()
    pairs = features.select("doc_id", F.explode("words").alias("word"))
    df = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    cut = max(2.0, n * FREQUENT)
    idf = F.log(F.lit(float(max(1, n))) / F.col("df")).alias("idf")
    often = df.where(F.col("df") >= cut).select("word", idf)
    seldom = df.where(F.col("df") < cut).select("word", idf)
    # words / n distinct words a document, each at least cut times: at most words / (n * FREQUENT) frequent ones
    mean_words = features.agg(F.avg(F.size("words"))).first()[0] or 0.0
    small = mean_words / FREQUENT < 500_000
    first = pairs.join(F.broadcast(often) if small else often, "word", "left")
    of_often = first.where("idf is not null").groupBy("doc_id").agg(F.sum("idf").alias("s"), F.count(F.lit(1)).alias("k"))
    of_seldom = first.where("idf is null").select("doc_id", "word").join(seldom.hint("shuffle_merge"), "word", "inner")
    of_seldom = of_seldom.groupBy("doc_id").agg(F.sum("idf").alias("s"), F.count(F.lit(1)).alias("k"))
    both = of_often.unionByName(of_seldom).groupBy("doc_id").agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
    return both.select("doc_id", (F.col("s") / F.col("k")).alias("rarity"))


def level_features(documents: DataFrame) -> DataFrame:
    """(doc_id, *FEATURES) of each document with prose, written once: fitting and scoring both read it."""
    base = settled(prose_features(documents), "prose")
    return settled(base.drop("words").join(word_rarity(base), "doc_id", "left").fillna(0.0, ["rarity"]), "levels")


def fit_ordinal(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, levels: int = 4) -> dict:
    """Ordered logit with common slopes over all thresholds, by Newton's method with a ridge on the slopes.

    y[i, k] is the share of judges who put text i above level k + 1. Returns mean, scale, slopes and ascending thresholds.
    """
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    n, p = z.shape
    k = levels - 1
    beta = np.zeros(p + k)
    beta[p:] = np.linspace(-1, 1, k)
    eye = np.diag([ridge] * p + [1e-2] * k)
    for _ in range(60):
        grad, hess = eye @ beta, eye.copy()
        for j in range(k):
            e = z @ beta[:p] - beta[p + j]
            pr = 1 / (1 + np.exp(-np.clip(e, -30, 30)))
            r, w = pr - y[:, j], np.maximum(pr * (1 - pr), 1e-9)
            grad[:p] += z.T @ r
            grad[p + j] -= r.sum()
            hess[:p, :p] += (z * w[:, None]).T @ z
            hess[:p, p + j] -= z.T @ w
            hess[p + j, :p] -= z.T @ w
            hess[p + j, p + j] += w.sum()
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "scale": scale, "slopes": beta[:p], "thresholds": np.sort(beta[p:])}


GROUPS = (*LANGUAGES, "other")


def _design(x: np.ndarray, language: list[str], mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, and per language the same once more with a constant: what it differs by from all."""
    z = (x - mean) / scale
    parts = [z]
    for g in GROUPS:
        own = np.array([[1.0] if k == g else [0.0] for k in language])
        parts += [z * own, own]
    return np.hstack(parts)


def fit_levels(features: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict:
    """Fit on the graded documents, at most `rows` of them (the lowest hashes of doc_id); judges of a text are averaged.

    Slopes are shared by the languages, with a ridged deviation for each, as words and sentences of one are longer than
    those of another. The result has mean, scale, thresholds, slopes and by language (deviations of the slopes, constant).
    """
    width = len(FEATURES)
    shares = [F.avg((F.col("level") > k).cast("double")).alias(f"y{k}") for k in (1, 2, 3)]
    graded = labels.where("doc_id is not null and level is not null").distinct().groupBy("doc_id").agg(*shares)
    sample = features.join(graded, "doc_id", "inner").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = sample.select("language", *FEATURES, "y1", "y2", "y3").collect()  # at most `rows` short rows
    if not got:
        none = np.zeros(width)
        return {"mean": none, "scale": none + 1, "slopes": none, "own": {g: (none, 0.0) for g in GROUPS}, "thresholds": np.array([0.0, 1.0, 2.0])}
    a = np.array([list(r)[1:] for r in got], dtype=float)
    x, y = a[:, :width], a[:, width:]
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    fit = fit_ordinal(_design(x, [r[0] for r in got], mean, scale), y)
    beta, shift = fit["slopes"] / fit["scale"], float((fit["mean"] / fit["scale"] * fit["slopes"]).sum())
    own = {g: (beta[width + i * (width + 1) :][:width], float(beta[width + i * (width + 1) + width])) for i, g in enumerate(GROUPS)}
    return {"mean": mean, "scale": scale, "slopes": beta[:width], "own": own, "thresholds": fit["thresholds"] + shift}


def score_levels(features: DataFrame, model: dict) -> DataFrame:
    """(doc_id, language, score, level, expected): a linear score in the JVM; level counts the thresholds below it."""
    score = F.lit(0.0)
    for i, name in enumerate(FEATURES):
        slope = F.lit(float(model["slopes"][i]))
        for g, (d, _) in model["own"].items():
            slope = slope + F.when(F.col("language") == g, float(d[i])).otherwise(0.0)
        score = score + (F.col(name) - float(model["mean"][i])) / float(model["scale"][i]) * slope
    for g, (_, c) in model["own"].items():
        score = score + F.when(F.col("language") == g, c).otherwise(0.0)
    scored = features.select("doc_id", "language", score.alias("score"))
    over = [(F.col("score") > float(t)).cast("int") for t in model["thresholds"]]
    soft = [1.0 / (1.0 + F.exp(float(t) - F.col("score"))) for t in model["thresholds"]]
    return scored.select("*", (F.lit(1) + sum(over[1:], over[0])).cast("int").alias("level"), (F.lit(1.0) + sum(soft[1:], soft[0])).alias("expected"))


def reading_levels(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Level 1 (easiest) to 4 of each document with prose; documents without prose, empty or null have no row.

    Without any graded document the model is flat and every document gets level 1.
    """
    features = level_features(documents)
    return score_levels(features, fit_levels(features, labels, rows))
