"""Text cleaning, tokens, n-grams, tf-idf, distances and vector search."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..semantics import col

# analytics -----------------------------------------------------------------


def words(a) -> Column:
    """Non-empty runs between white space."""
    return F.filter(F.split(col(a), r"\s+"), lambda w: w != "")


def token_count(a) -> Column:
    return F.coalesce(F.when(col(a).isNotNull(), F.size(words(a))), F.lit(0))


def char_count(a) -> Column:
    return F.coalesce(F.length(col(a)), F.lit(0))


def sentence_count(a) -> Column:
    return F.coalesce(F.when(col(a).isNotNull(), F.size(F.filter(F.split(col(a), r"[.!?]+"), lambda s: F.trim(s) != ""))), F.lit(0))


def average_word_length(a) -> Column:
    w = words(a)
    return F.coalesce(F.try_divide(F.length(F.array_join(w, "")).cast("double"), F.size(w).cast("double")), F.lit(0.0))


def word_frequency(df: DataFrame, name: str, lower: bool = False) -> DataFrame:
    """(word, count), commonest first; counted before the shuffle."""
    c = F.lower(col(name)) if lower else col(name)
    return df.select(F.explode(words(c)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "word")


# cleaning --------------------------------------------------------------------

_STEPS = (
    ("html", r"<[^>]+>", " "),
    ("urls", r"https?://\S+|www\.\S+", " "),
    ("emails", r"[\w.+-]+@[\w-]+\.[\w.-]+", " "),
    ("numbers", r"\d+", " "),
)


def clean(a, html: bool = True, urls: bool = True, emails: bool = True, numbers: bool = False, lower: bool = True, spaces: bool = True) -> Column:
    """Chosen removals in a fixed order, then lower case, then single spaces."""
    c, on = col(a), {"html": html, "urls": urls, "emails": emails, "numbers": numbers}
    for name, pattern, new in _STEPS:
        if on[name]:
            c = F.regexp_replace(c, pattern, new)
    c = F.lower(c) if lower else c
    return F.trim(F.regexp_replace(c, r"\s+", " ")) if spaces else c


#: Short function-word lists; give ``custom`` for more.
STOP_WORDS = {
    "en": "a an and are as at be but by for from had has have he her his i if in is it its me my no not of on or our she so that the their them they this to was we were what which who will with you your",
    "es": "a al como con de del el ella en es esta este la las lo los me mi no o para pero por que se si sin su sus un una y ya yo",
    "fr": "au aux avec ce ces dans de des du elle en et il je la le les leur lui ma mais me ne nous on ou par pas pour qu que qui sa se son sur un une vous",
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die du ein eine er es für hat ich im in ist ja mit nicht oder sie sich so und uns von war was wie wir zu zum",
}


def remove_stop_words(a, language: str = "en", custom: Sequence[str] = ()) -> Column:
    """The text without stop words, whatever their case; single spaces."""
    stop = F.array(*[F.lit(w) for w in sorted({*STOP_WORDS[language].split(), *(w.lower() for w in custom)})])
    return F.array_join(F.filter(words(a), lambda w: ~F.array_contains(stop, F.lower(w))), " ")


def ngrams(a, lo: int, hi: int | None = None) -> Column:
    """Array of space-joined n-grams of lo to hi words."""
    w = words(a)
    out = []
    for n in range(lo, (hi or lo) + 1):
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        out.append(F.transform(starts, _gram(w, n)))
    return F.concat(*out) if len(out) > 1 else out[0]


def _gram(w: Column, n: int):
    return lambda i: F.array_join(F.slice(w, i, n), " ")


def ngram_counts(df: DataFrame, name: str, lo: int, hi: int | None = None) -> DataFrame:
    return df.select(F.explode(ngrams(name, lo, hi)).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("count"))


_ABBREVIATIONS = "Mr Mrs Ms Dr Prof Sr Jr St vs etc e.g i.e Inc Ltd Co Corp U.S U.K No Fig".split()


def sentences(a) -> Column:
    """Sentences: breaks after . ! ? before a capital, not after known abbreviations."""
    c = col(a)
    for w in _ABBREVIATIONS:
        c = F.regexp_replace(c, r"\b" + re.escape(w) + r"\.", w.replace(".", "\u0001") + "\u0001")
    parts = F.split(c, r"(?<=[.!?])\s+(?=\p{Lu})")
    return F.filter(F.transform(parts, lambda s: F.trim(F.translate(s, "\u0001", "."))), lambda s: s != "")


# stems and lemmas: on distinct words, joined back -------------------------------


def map_words(df: DataFrame, name: str, f, out: str) -> DataFrame:
    """``f`` (word -> word) applied to all words of a text, once for each distinct word of an Arrow batch."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        made = []
        for t in s:
            if t is None:
                made.append(None)
                continue
            ws = t.split()
            for w in ws:
                if w not in known:
                    known[w] = f(w)
            made.append(" ".join(known[w] for w in ws))
        return pd.Series(made, dtype=object)

    return df.withColumn(out, run(col(name)))


_VOWELS = "aeiou"


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    kinds = "".join("v" if c in _VOWELS or (c == "y" and i and stem[i - 1] not in _VOWELS) else "c" for i, c in enumerate(stem))
    return len(re.findall("v+c+", kinds))


def _has_vowel(stem: str) -> bool:
    return any(c in _VOWELS or (c == "y" and i) for i, c in enumerate(stem))


def _ends_cvc(w: str) -> bool:
    return len(w) > 2 and w[-1] not in _VOWELS + "wxy" and (w[-2] in _VOWELS or w[-2] == "y") and w[-3] not in _VOWELS


#: Fixed suffix rules of Porter's algorithm, steps 2 to 4.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def stem(word: str) -> str:
    """Porter's stemmer."""
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lsz" + _VOWELS:
                    w = w[:-1]
                elif _measure(w) == 1 and _ends_cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for rule in sorted(rules.split(), key=lambda r: -len(r.split(":")[0])):
            old, new = rule.split(":")
            if w.endswith(old):
                if _measure(w[: -len(old)]) > 0:
                    w = w[: -len(old)] + new
                break
    for old in sorted(_STEP4.split(), key=len, reverse=True):
        if w.endswith(old):
            base = w[: -len(old)]
            if _measure(base) > 1 and (old != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


_IRREGULAR = dict(p.split(":") for p in "was:be were:be is:be are:be been:be am:be has:have had:have does:do did:do done:do went:go gone:go goes:go ran:run saw:see seen:see took:take taken:take came:come made:make said:say got:get men:man women:woman children:child feet:foot teeth:tooth mice:mouse geese:goose better:good best:good worse:bad worst:bad".split())


def lemma(word: str, extra: dict[str, str] | None = None) -> str:
    """Irregular forms by table, regular endings by rule."""
    w = word.lower()
    if extra and w in extra:
        return extra[w]
    if w in _IRREGULAR:
        return _IRREGULAR[w]
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    if w.endswith(("sses", "shes", "ches", "xes", "zes")):
        return w[:-2]
    if len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")):
        return w[:-1]
    for end in ("ing", "ed"):
        base = w[: -len(end)]
        if w.endswith(end) and len(base) > 2 and _has_vowel(base):
            if base[-1] == base[-2] and base[-1] not in "lsz":
                return base[:-1]
            return base + "e" if _ends_cvc(base) and _measure(base) == 1 else base
    return w


# distances ---------------------------------------------------------------------


def levenshtein(a, b) -> Column:
    return F.levenshtein(col(a), col(b) if isinstance(b, Column) else F.lit(b) if not isinstance(b, str) else col(b))


def jaro_winkler_value(s: str, t: str, scale: float = 0.1) -> float:
    if s == t:
        return 1.0
    if not s or not t:
        return 0.0
    reach = max(max(len(s), len(t)) // 2 - 1, 0)
    hit_s, hit_t = [False] * len(s), [False] * len(t)
    m = 0
    for i, c in enumerate(s):
        for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
            if not hit_t[j] and t[j] == c:
                hit_s[i] = hit_t[j] = True
                m += 1
                break
    if not m:
        return 0.0
    a = [c for c, h in zip(s, hit_s, strict=True) if h]
    b = [c for c, h in zip(t, hit_t, strict=True) if h]
    half = sum(x != y for x, y in zip(a, b, strict=True)) / 2
    jaro = (m / len(s) + m / len(t) + (m - half) / m) / 3
    prefix = 0
    for x, y in zip(s[:4], t[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * min(scale, 0.25) * (1 - jaro)


def jaro_winkler(a, b, scale: float = 0.1) -> Column:
    """Arrow batches (no built-in function)."""
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else jaro_winkler_value(s, t, scale) for s, t in zip(x, y, strict=True)], dtype=float)

    return run(col(a), col(b))


# vectors -------------------------------------------------------------------------


def dot(a, b) -> Column:
    x, y = (col(v) if isinstance(v, (str, Column)) else F.array(*[F.lit(float(e)) for e in v]) for v in (a, b))
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, e: s + e)


def cosine_similarity(a, b) -> Column:
    """0 where a norm is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.when(dot(a, b).isNotNull(), 0.0))


def semantic_search(df: DataFrame, vector: str, query: Sequence[float], k: int, keys: Sequence[str]) -> DataFrame:
    """The k rows nearest by cosine: a local top-k in each task, then one merge."""
    return df.select(*map(col, keys), cosine_similarity(vector, query).alias("score")).orderBy(F.desc("score"), *map(col, keys)).limit(k)


# tf-idf -----------------------------------------------------------------------------


def tokens(a) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(col(a)), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def tf_idf(df: DataFrame, key: str, name: str, smooth: bool = True, max_features: int | None = None) -> DataFrame:
    """(key, term, tf, idf, tfidf): tf = n / length; idf = ln((N + 1) / (df + 1)) + 1, or ln(N / df) unsmoothed."""
    base = df.select(col(key).alias(key), tokens(name).alias("__t"))
    counts = base.select(key, F.size("__t").alias("__len"), F.explode("__t").alias("term")).groupBy(key, "term", "__len").agg(F.count(F.lit(1)).alias("n"))
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total"))
    if max_features is not None:
        stats = stats.orderBy(F.desc("total"), "term").limit(max_features)
    total = base.agg(F.count(F.lit(1)).alias("__N"))
    idf = F.ln((F.col("__N") + 1) / (F.col("df") + 1)) + 1 if smooth else F.ln(F.col("__N") / F.col("df"))
    weights = stats.join(F.broadcast(total)).select("term", idf.alias("idf"))
    tf = F.col("n") / F.col("__len")
    return counts.join(weights, "term").select(key, "term", tf.alias("tf"), "idf", (tf * F.col("idf")).alias("tfidf"))


def similarity_matrix(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key_a, key_b, similarity) of all pairs of documents that share a term, whatever their number.

    Cosine of unsmoothed tf-idf. The work grows with the pairs that share a term, as the result does.
    """
    w = tf_idf(df, key, name, smooth=False).select(key, "term", "tfidf")
    norms = w.groupBy(key).agg(F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("norm"))
    a, b = w.toDF("key_a", "term", "wa"), w.toDF("key_b", "term", "wb")
    pairs = a.join(b, "term").where("key_a < key_b").groupBy("key_a", "key_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    out = pairs.join(norms.toDF("key_a", "na"), "key_a").join(norms.toDF("key_b", "nb"), "key_b")
    return out.select("key_a", "key_b", F.coalesce(F.try_divide(F.col("dot"), F.col("na") * F.col("nb")), F.lit(0.0)).alias("similarity"))


# tokenizers ---------------------------------------------------------------------------


class WordPiece:
    """Greedy longest-match pieces with '##' continuations; ids and attention mask."""

    def __init__(self, vocab: Sequence[str], unknown: str = "[UNK]", lower: bool = True):
        self.ids = {w: i for i, w in enumerate(vocab)}
        self.unknown, self.lower = unknown, lower

    def pieces(self, word: str) -> list[str]:
        out, at = [], 0
        while at < len(word):
            end = len(word)
            while end > at and ("##" if at else "") + word[at:end] not in self.ids:
                end -= 1
            if end == at:
                return [self.unknown]
            out.append(("##" if at else "") + word[at:end])
            at = end
        return out

    def encode(self, text: str) -> list[int]:
        found = re.findall(r"\w+|[^\w\s]", text.lower() if self.lower else text)
        return [self.ids.get(p, self.ids.get(self.unknown, 0)) for w in found for p in self.pieces(w)]


class RegexTokenizer:
    """Pieces by pattern; ids by a vocabulary, unknown ones 0."""

    def __init__(self, pattern: str = r"\S+", vocab: Sequence[str] = ()):
        self.find, self.ids = re.compile(pattern).findall, {w: i + 1 for i, w in enumerate(vocab)}

    def encode(self, text: str) -> list[int]:
        return [self.ids.get(w, 0) for w in self.find(text)]


class Bpe:
    """Byte-pair merges in rank order over the characters of words with an end mark."""

    def __init__(self, merges: Sequence[tuple[str, str]], vocab: Sequence[str], end: str = "</w>"):
        self.rank, self.ids, self.end = {m: i for i, m in enumerate(merges)}, {w: i for i, w in enumerate(vocab)}, end

    def pieces(self, word: str) -> list[str]:
        parts = [*word[:-1], word[-1] + self.end] if word else []
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def encode(self, text: str) -> list[int]:
        return [self.ids.get(p, 0) for w in text.split() for p in self.pieces(w)]


def tokenize(df: DataFrame, name: str, tokenizer, out: str = "tokens", max_length: int | None = None) -> DataFrame:
    """``out`` (ids) and ``out``_mask arrays by a tokenizer object, in Arrow batches; with ``max_length`` cut and padded."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        t = shared.value
        return pd.Series([None if x is None else t.encode(x)[:max_length] for x in s])

    ids = df.withColumn(out, run(col(name)))
    mask = F.transform(col(out), lambda _: F.lit(1))
    if max_length is None:
        return ids.withColumn(f"{out}_mask", mask)
    fill = F.array_repeat(F.lit(0), F.greatest(F.lit(max_length) - F.size(col(out)), F.lit(0)))
    return ids.withColumn(f"{out}_mask", F.concat(mask, fill)).withColumn(out, F.concat(col(out), fill))
