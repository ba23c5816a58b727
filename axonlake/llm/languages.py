"""Languages of documents and their sentences by prediction by partial matching (PPM).

One variable-order context tree per language holds how often each byte of UTF-8 text followed each context of up to ``ORDER``
bytes; letters are in lower case, accents are kept. The code length of a text under a tree is exact for PPM with escapes (method C, without exclusions): from the
longest known context, a seen symbol costs -log2(count / (total + distinct)), an unseen one costs the escape
-log2(distinct / (total + distinct)) and goes on in the next shorter context, down to a flat code. The trees are built
once and frozen; a sentence belongs to the language whose tree codes it in the fewest bits, if the other trees need clearly
more, and the confidence is the posterior that these code lengths imply. Contexts are short, so that the trees also tell
languages apart in texts about other things than those they were built from.

For speed the trees are kept as flat tables: per order, the sorted known n-grams with their cost under every language
(escapes included), so that scoring is one binary search per symbol in most cases.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt")

#: Other codes and names of these languages (ISO 639 and the languages' names in English and their own).
SPELLINGS = {
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "esp", "spanish", "espanol", "español", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "francais", "français"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "pt": ("pt", "por", "portuguese", "portugues", "português"),
}


def label_code(label: Column) -> Column:
    """The two-letter code that a label means, whatever its spelling or region; null for anything else."""
    first = F.lower(F.trim(F.regexp_extract(F.coalesce(label, F.lit("")), r"^\s*([^\s_\-,;(/]+)", 1)))
    out = F.lit(None).cast("string")
    for code, names in SPELLINGS.items():
        out = F.when(first.isin(*names), F.lit(code)).otherwise(out)
    return out


ORDER = 3
BITS = 8  # symbols: bytes; all digits are one symbol and all white space another
PAD = 32  # what precedes a text
_SYMBOL = np.arange(256, dtype=np.uint32)
_SYMBOL[list(b"123456789")] = ord("0")
_SYMBOL[list(b"\t\n\r\f\v")] = PAD

#: Typographic marks and their plain forms.
FOLDS = {ord("’"): "'", ord("‘"): "'", ord("–"): "-", ord("—"): "-", 0xA0: " "}
#: Letters that Unicode does not decompose, as they are written without accents.
PLAIN = {ord("ß"): "ss", ord("æ"): "ae", ord("œ"): "oe", ord("ø"): "o"}


def symbols(text: str) -> np.ndarray:
    """The bytes of the text in lower case."""
    low = text.lower()
    return _SYMBOL[np.frombuffer((low if low.isascii() else low.translate(FOLDS)).encode("utf-8", "replace"), np.uint8)]


def unaccented(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c)).translate(PLAIN)


_PAD = np.full(ORDER, PAD, np.uint32)


def grams(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol of every piece its ORDER preceding symbols and itself as one number; and where each piece starts."""
    sizes = np.array([len(p) for p in pieces])
    flat = np.concatenate([x for p in pieces for x in (_PAD, p)]) if pieces else np.zeros(0, np.uint32)
    key = np.zeros(max(0, len(flat) - ORDER), np.uint32)
    for k in range(ORDER + 1):
        key |= flat[k : k + len(key)] << np.uint32(BITS * (ORDER - k))
    ends = np.cumsum(sizes + ORDER)
    own = np.ones(len(flat), bool)
    for j in range(ORDER):
        own[ends - sizes - ORDER + j] = False
    return key[own[ORDER:]] if len(flat) else key, np.cumsum(sizes) - sizes


@dataclass
class Trees:
    """Frozen trees of all languages: per order, known n-grams and their costs, and known contexts and their escapes; and the
    letters beyond a-z that any of the languages uses (None: not known)."""

    languages: tuple
    gram_keys: list
    gram_costs: list
    ctx_keys: list
    ctx_costs: list
    letters: frozenset | None = None

    def strange(self, text: str) -> int:
        """How many letters of the text none of the languages uses."""
        if self.letters is None or text.isascii():
            return 0
        return sum(1 for c in text.lower() if c > "\x7f" and c.isalpha() and c not in self.letters)


def grow(samples: dict[str, list[np.ndarray]]) -> Trees:
    langs = tuple(samples)
    seen = {g: grams(s)[0] for g, s in samples.items()}
    flat = float(BITS)
    out = Trees(langs, [], [], [], [])
    for k in range(ORDER + 1):
        mask = np.uint32((1 << BITS * (k + 1)) - 1)
        counts = {g: np.unique(a & mask, return_counts=True) for g, a in seen.items()}
        union = np.unique(np.concatenate([c[0] for c in counts.values()]))
        ctx = np.unique(union >> np.uint32(BITS))
        if k:
            low = np.searchsorted(out.gram_keys[-1], union & np.uint32((1 << BITS * k) - 1))
            cost = out.gram_costs[-1][low].copy()
        else:
            cost = np.full((len(union), len(langs)), flat, np.float32)
        esc = np.zeros((len(ctx), len(langs)), np.float32)
        for j, g in enumerate(langs):
            keys, n = counts[g]
            c, at, distinct = np.unique(keys >> np.uint32(BITS), return_index=True, return_counts=True)
            total = np.add.reduceat(n, at) if len(n) else n
            esc[np.searchsorted(ctx, c), j] = -np.log2(distinct / (total + distinct))
            cost[:, j] += esc[np.searchsorted(ctx, union >> np.uint32(BITS)), j]
            own = np.searchsorted(c, keys >> np.uint32(BITS))
            cost[np.searchsorted(union, keys), j] = -np.log2(n / (total + distinct)[own])
        out.gram_keys.append(union)
        out.gram_costs.append(cost)
        out.ctx_keys.append(ctx)
        out.ctx_costs.append(esc)
    return out


def _find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return at, keys[at] == want


def code_lengths(trees: Trees, pieces: list[np.ndarray]) -> np.ndarray:
    """Bits of each piece (rows) under each language's tree (columns)."""
    n = len(trees.languages)
    if not pieces:
        return np.zeros((0, n))
    key, start = grams(pieces)
    total = np.zeros((len(key), n), np.float32)
    todo = np.arange(len(key))
    for k in range(ORDER, -1, -1):
        want = key[todo] & np.uint32((1 << BITS * (k + 1)) - 1)
        at, hit = _find(trees.gram_keys[k], want)
        total[todo[hit]] += trees.gram_costs[k][at[hit]]
        todo, want = todo[~hit], want[~hit]
        if not len(todo):
            break
        at, hit = _find(trees.ctx_keys[k], want >> np.uint32(BITS))
        total[todo[hit]] += trees.ctx_costs[k][at[hit]]
    total[todo] += np.float32(BITS)
    sums = np.zeros((len(pieces), n))
    some = np.array([len(p) > 0 for p in pieces])
    if len(key):
        sums[some] = np.add.reduceat(total.astype(np.float64), start[some], axis=0)
    return sums


_LINE = re.compile(r"[^\n\r]+")
_BREAK = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|(?<=[。！？])")
_LEAD = re.compile(r"[\s>*•#|\-–—]+")
_WORD = re.compile(r"[^\W\d_]{2,}(?:['’\-][^\W\d_]+)*|[^\W\d_]['’][^\W\d_]{2,}")
_SIGN = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\u0e00-\u0e7f]")  # kana, ideographs, hangul, Thai
_NO_LETTER = bytes(c for c in range(128) if not chr(c).isalpha())
_EDGE = ".,;:!?…\"“”«»()[]'’"


@dataclass(frozen=True)
class SentenceRules:
    """A sentence has at least ``words`` plain words (of scripts without spaces, two signs are a word) and ``letters`` of its
    characters are letters. It is in the language of the cheapest tree if the other trees need on average ``factor`` times its
    bits and ``lead`` bits per byte more; both are relative, so plain and unusual sentences are measured alike. Two letters or
    more, and ``strange`` of its characters, that none of the languages uses make it another language. Stretches of more
    than ``longest`` words (or eight times as many characters) without an end mark are cut into such pieces."""

    words: int = 4
    letters: float = 0.6
    factor: float = 1.2
    lead: float = 0.35
    strange: float = 0.02
    longest: int = 60


def split_sentences(text: str, rules: SentenceRules = SentenceRules()) -> list[tuple[int, int]]:
    """(start, end) of every stretch of the text that may be a sentence: lines, cut after end marks."""
    out = []
    for line in _LINE.finditer(text):
        s, body = line.start(), line.group()
        cuts, last = [], 0
        for m in _BREAK.finditer(body):
            cuts.append((last, m.start()))
            last = m.end()
        cuts.append((last, len(body)))
        for a, b in cuts:
            m = _LEAD.match(body, a, b)
            a = m.end() if m else a
            while b > a and body[b - 1].isspace():
                b -= 1
            if body.count(" ", a, b) < rules.longest:
                # a stretch without spaces is cut by length alone
                step = max(1, b - a) if b - a <= 8 * rules.longest or body.find(" ", a, b) >= 0 else 8 * rules.longest
                out += [(s + c, s + min(c + step, b)) for c in range(a, b, step)]
                continue
            tokens = body[a:b].split(" ")
            at = a
            for i in range(0, len(tokens), rules.longest):
                size = len(" ".join(tokens[i : i + rules.longest]))
                out.append((s + at, s + at + size))
                at += size + 1
    return [(a, b) for a, b in out if b > a]


def is_sentence(piece: str, rules: SentenceRules = SentenceRules()) -> bool:
    """Whether a stretch has the shape of a sentence: enough plain words, mostly letters."""
    plain = 0
    for token in piece.split():
        if _WORD.fullmatch(token.strip(_EDGE)):
            plain += 1
            if plain == rules.words:
                break
    if plain < rules.words and not piece.isascii():
        plain += len(_SIGN.findall(piece)) // 2
    if plain < rules.words:
        return False
    blanks = piece.count(" ")
    letters = len(piece.encode().translate(None, _NO_LETTER)) if piece.isascii() else sum(map(str.isalpha, piece))
    return letters >= rules.letters * max(1, len(piece) - blanks)


def train_trees(docs: DataFrame, per_language: int = 400, most_chars: int = 4000, rounds: int = 3, rules: SentenceRules = SentenceRules()) -> Trees:
    """Trees from a bounded sample of labelled documents: per language ``per_language`` documents of at most ``most_chars``
    characters, the first by a hash of text and id. These two parameters bound the rows sent to the driver.

    Labels may be wrong and texts mixed: after each round every sample sentence moves to the language whose tree codes it
    best, and the trees are built anew. Repeated sentences count each, so that a few mislabelled copies do not hold a sentence
    against the many in its own language. Every sentence is in its tree as it is and without accents. A language without any sample has no tree and is never assigned.
    """
    code = label_code(F.col("lang"))
    given = docs.select(code.alias("_code"), "text", F.xxhash64("text", F.col("doc_id")).alias("_h")).where(F.col("_code").isNotNull() & F.length("text").between(40, most_chars))
    first = given.withColumn("_n", F.row_number().over(W.partitionBy("_code").orderBy("_h"))).where(F.col("_n") <= per_language)
    rows = first.select("_code", "text").toPandas()
    sentences: dict[str, list[str]] = {}
    for code_, text in zip(rows["_code"], rows["text"]):
        for a, b in split_sentences(text, rules):
            piece = text[a:b]
            if is_sentence(piece, rules):
                sentences.setdefault(code_, []).append(piece)
    given_ = [(g, p) for g in LANGUAGES for p in sentences.get(g, [])]
    labels = [g for g, _ in given_]
    pieces = [symbols(p) for _, p in given_]
    bare = [None if p.isascii() else symbols(unaccented(p)) for _, p in given_]
    for r in range(rounds):
        chosen = {g: [x for h, p, b in zip(labels, pieces, bare) if h == g for x in (p, b) if x is not None] for g in LANGUAGES if g in labels}
        trees = grow(chosen) if pieces else None
        if trees is not None:
            trees.letters = frozenset(c for _, p in given_ if not p.isascii() for c in p.lower() if c > "\x7f" and c.isalpha())
        if trees is None or r == rounds - 1:
            return trees
        best = code_lengths(trees, pieces).argmin(axis=1)
        labels = [trees.languages[i] for i in best]
    return trees


_SEGMENT = "seg long, first_char long, last_char long, seg_lang string, bits_per_byte double, confidence double"


def segment_languages(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text: str = "text", rules: SentenceRules = SentenceRules(), keep: tuple[str, ...] = (), batch_symbols: int = 400_000, every: bool = False) -> DataFrame:
    """One row per sentence of each document: id, kept columns, seg (from 0), first_char, last_char (exclusive), seg_lang, bits_per_byte, confidence.

    ``confidence`` is the posterior of the language over all trees under equal priors, with the code lengths of a sentence
    counted at a quarter as its symbols are not independent evidence. Null and empty texts and stretches without a sentence
    give no rows, unless ``every``: then a document without a sentence has one row with seg null and seg_lang ``und``. A sentence
    that no tree codes clearly better than the others (another language) has seg_lang ``und`` and confidence 0. Whole texts are
    scored, of any length.
    """
    bc = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the training sample
    cols = [id_col, *keep]

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = bc.value
        names = [*cols, *[c.split()[0] for c in _SEGMENT.split(", ")]]
        for pdf in it:
            pdf = pdf.reset_index(drop=True)
            rows: list[tuple] = []
            pieces: list[np.ndarray] = []
            held = 0

            def flush() -> pd.DataFrame:
                nonlocal rows, pieces, held
                cost = code_lengths(t, pieces)
                best = cost.argmin(axis=1)
                low = cost[np.arange(len(best)), best]
                size = np.array([len(p) for p in pieces])
                p = 1 / np.exp2(np.clip(-(cost - low[:, None]) / 4, -60, 0)).sum(axis=1)
                out = pdf.loc[[r[0] for r in rows], cols].reset_index(drop=True)
                out["seg"], out["first_char"], out["last_char"] = [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]
                others = (cost.sum(axis=1) - low) / (cost.shape[1] - 1) if cost.shape[1] > 1 else BITS * size
                odd = np.array([r[4] for r in rows])
                good = (others >= rules.factor * low + rules.lead * size) & ~((odd >= 2) & (odd > rules.strange * size))
                out["seg_lang"] = np.where(good, np.array(t.languages)[best], "und")
                out["bits_per_byte"] = low / np.maximum(size, 1)
                out["confidence"] = np.where(good, p, 0.0)
                rows, pieces, held = [], [], 0
                return out[names]

            bare: list[int] = []
            for i, body in enumerate(pdf["_text"]):
                n = 0
                for a, b in split_sentences(body, rules) if isinstance(body, str) and t is not None else ():
                    piece = body[a:b]
                    if is_sentence(piece, rules):
                        rows.append((i, n, a, b, t.strange(piece)))
                        pieces.append(symbols(piece))
                        held += len(pieces[-1])
                        n += 1
                        if held >= batch_symbols:
                            yield flush()
                if not n:
                    bare.append(i)
            if rows:
                yield flush()
            if every and bare:
                out = pdf.loc[bare, cols].reset_index(drop=True)
                yield out.assign(seg=pd.array([None] * len(bare), "Int64"), first_char=0, last_char=0, seg_lang="und", bits_per_byte=np.nan, confidence=0.0)[names]

    given = docs.select(*cols, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*cols).schema) + ", " + _SEGMENT
    return given.mapInPandas(score, schema)


def document_languages(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, lang (of most characters), confidence (its part of the characters times its mean confidence), n_langs, n_sentences.

    One row per document of ``segments``; with those of ``segment_languages(every=True)`` that is every document, ``und`` with
    confidence 0 if it has no sentence or none of a known language. ``n_langs`` counts the known languages. Rows with equal ids
    are one document; a null id is one too.
    """
    s = segments.withColumn("_c", F.col("last_char") - F.col("first_char"))
    by = s.groupBy(id_col, "seg_lang").agg(F.sum("_c").alias("_c"), F.sum(F.col("_c") * F.col("confidence")).alias("_p"), F.count("seg").alias("_n"))
    top = F.max_by(F.struct("seg_lang", "_p"), F.struct("_c", "seg_lang"))
    g = by.groupBy(id_col).agg(top.alias("_t"), F.sum("_c").alias("_all"), F.count_if(F.col("seg_lang") != "und").alias("n_langs"), F.sum("_n").alias("n_sentences"))
    return g.select(id_col, F.col("_t.seg_lang").alias("lang"), F.coalesce(F.try_divide(F.col("_t._p"), F.col("_all")), F.lit(0.0)).alias("confidence"), "n_langs", "n_sentences")


def wrong_labels(docs: DataFrame, per_language: int = 400, rules: SentenceRules = SentenceRules()) -> DataFrame:
    """(doc_id, lang): every language of the documents whose label is missing or wrong or whose text mixes languages.

    A label in another spelling is right. Documents without a sentence, with null or empty text among them, are no cases.
    Sentences of no known language give no row, but a label that only they could fulfil counts as wrong. Repeated rows of a
    document give one row per language. Empty input gives no rows.
    """
    given = docs.withColumn("_code", label_code(F.col("lang")))
    seg = segment_languages(given, train_trees(docs, per_language, rules=rules), keep=("_code",), rules=rules).where(F.col("seg_lang") != "und")
    # a document's sentences meet in one row per language; the few languages of a document in one row
    each = seg.groupBy("doc_id", "seg_lang").agg(F.max("_code").alias("_code"), F.max("confidence").alias("best"))
    per = each.groupBy("doc_id").agg(F.collect_set("seg_lang").alias("langs"), F.max("_code").alias("_code"))
    case = F.col("_code").isNull() | ~F.array_contains("langs", F.col("_code")) | (F.size("langs") > 1)
    return per.where(case).select("doc_id", F.explode("langs").alias("lang"))
