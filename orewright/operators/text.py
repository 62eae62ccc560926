"""Tokens, vocabulary, phrases, exact search and text projections."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A token: a maximal run of letters, digits and underscores, lower-cased.
TOKEN = r"[\p{L}\p{N}_]+"


def tokens_of(text: Column) -> Column:
    """The tokens of a text in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_tokens(query: str) -> list[str]:
    return re.findall(r"\w+", query.lower())


def with_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.where(F.col(text).isNotNull()).withColumn("toks", tokens_of(F.col(text)))


def token_stream(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, tok) of every token."""
    return with_tokens(docs.select(key, text), text).select(key, F.posexplode("toks").alias("pos", "tok"))


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(tok, freq) over all rows."""
    return with_tokens(docs.select(text), text).select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("freq"))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(tok, key, tf, first_pos, positions). Texts are dealt by key, so their tokens meet where they are made:
    the text is shuffled once, and no row a token."""
    return token_stream(docs.select(key, text).repartition(key), key, text).groupBy("tok", key).agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"), F.sort_array(F.collect_list("pos")).alias("positions"))


def has_literals(text: Column, words: Sequence[str], every: bool = True) -> Column:
    """The literal prefilter: all (or any) of the words occur in the lower-cased text."""
    low = F.lower(text)
    parts = [F.contains(low, F.lit(w)) for w in words]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if every else (out | p)
    return out


def phrase_positions(toks: Column, query: Sequence[str]) -> Column:
    """Positions at which the tokens of `query` stand one after another."""
    # shifted copies side by side: the tokens are made once a row, never inside the lambda
    shifted = [toks if j == 0 else F.slice(toks, j + 1, 1 << 30) for j in range(len(query))]
    side = F.arrays_zip(*[c.alias(f"t{j}") for j, c in enumerate(shifted)])

    def equal(x: Column) -> Column:
        out = x["t0"] == query[0]
        for j in range(1, len(query)):
            out = out & (x[f"t{j}"] == query[j])
        return out

    return F.filter(F.transform(side, lambda x, i: F.when(equal(x), i)), lambda v: v.isNotNull())


def phrase_hits(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos) of the exact phrase."""
    q = query_tokens(query)
    d = with_tokens(docs.select(key, text).where(has_literals(F.col(text), q)), text)
    return d.select(key, F.explode(phrase_positions(F.col("toks"), q)).alias("pos"))


NEGATIONS = ("не", "ни")


def _places_of(word: str) -> Column:
    return F.transform("toks", lambda t, i: F.when(t == word, i))


def proximity_hits(docs: DataFrame, query: str, window: int = 128, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos): occurrences of the document's rarest query token with all others within
    `window` tokens, in documents without the exact phrase; none for queries that negate."""
    q = list(dict.fromkeys(query_tokens(query)))
    d = with_tokens(docs.select(key, text).where(has_literals(F.col(text), q)), text)
    if len(q) < 2 or any(x in NEGATIONS for x in q):
        return d.select(key, F.lit(0).alias("pos")).where(F.lit(False))
    places = [F.filter(_places_of(x), lambda v: v.isNotNull()).alias(f"p{k}") for k, x in enumerate(q)]
    exact = phrase_positions(F.col("toks"), query_tokens(query))
    d = d.where(F.size(exact) == 0).select(key, *places)
    sizes = [F.size(f"p{k}") for k in range(len(q))]
    d = d.where(F.least(*sizes) > 0)
    anchor = F.coalesce(*[F.when(s == F.least(*sizes), F.lit(k)) for k, s in enumerate(sizes)])
    d = d.withColumn("a", anchor).withColumn("all", F.array(*[F.col(f"p{k}") for k in range(len(q))]))
    near = lambda a: F.forall("all", lambda ps: F.exists(ps, lambda p: F.abs(p - a) <= window))
    return d.select(key, F.explode(F.filter(F.get("all", F.col("a")), near)).alias("pos"))


def prefix_tokens(docs: DataFrame, prefix: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, tok) of tokens that start with the anchor."""
    d = with_tokens(docs.select(key, text).where(has_literals(F.col(text), [prefix.lower()])), text)
    hit = F.filter(F.transform("toks", lambda t, i: F.struct(i.alias("pos"), t.alias("tok"))), lambda x: F.startswith(x["tok"], F.lit(prefix.lower())))
    return d.select(key, F.inline(hit).alias("pos", "tok"))


# ---- exact search -------------------------------------------------------------------------


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, byte_offset, line): lines from 1 with the offset of their first byte."""
    d = docs.select(key, text).where(F.col(text).isNotNull())
    cut = F.split(F.col(text), "\n")
    ex = d.select(key, F.posexplode(cut).alias("i", "line"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("line").cast("bigint") + 1).over(w), F.lit(0))
    return ex.select(key, (F.col("i") + 1).alias("line_no"), before.alias("byte_offset"), "line")


def matcher(line: Column, pattern: str, literal: bool = True, ignore_case: bool = False) -> Column:
    """Whether a line matches. Look-around and back-references are refused, as they can't be matched in linear time."""
    if literal:
        return F.contains(F.lower(line), F.lit(pattern.lower())) if ignore_case else F.contains(line, F.lit(pattern))
    if re.search(r"\(\?[=!<]|\\[1-9]|\\k<", pattern):
        raise ValueError(f"look-around and back-references aren't supported: {pattern}")
    return F.rlike(line, F.lit(("(?iu)" if ignore_case else "") + pattern))


def grep(docs: DataFrame, pattern: str, literal: bool = True, ignore_case: bool = False, max_count: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, byte_offset, line) of matching lines; texts with a NUL are binary and skipped."""
    d = docs.select(key, text).where(~F.contains(F.col(text), F.lit("\u0000")))
    d = d.where(matcher(F.col(text), pattern, literal, ignore_case) if literal else F.lit(True))
    hit = lines(d, key, text).where(matcher(F.col("line"), pattern, literal, ignore_case))
    if max_count is not None:
        w = Window.partitionBy(key).orderBy("line_no")
        hit = hit.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_count).drop("rn")
    return hit


def grep_context(docs: DataFrame, pattern: str, before: int, after: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, grp, line_no, is_match): matching lines with context, touching ones merged into groups."""
    d = docs.select(key, text).where(F.contains(F.col(text), F.lit(pattern)))
    ln = lines(d, key, text).withColumn("m", F.contains("line", F.lit(pattern)).cast("int"))
    w = Window.partitionBy(key).orderBy("line_no")
    ln = ln.withColumn("near", F.max("m").over(w.rowsBetween(-after, before))).where("near = 1")
    ln = ln.withColumn("gap", (F.col("line_no") - F.coalesce(F.lag("line_no").over(w), F.lit(-9)) > 1).cast("int"))
    return ln.select(key, F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("grp"), "line_no", (F.col("m") == 1).alias("is_match"))


def occurrences(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("bigint")


def grep_counts(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, matched_lines, occurrences) of texts with a match, without making rows of lines."""
    d = docs.select(key, text).where(F.contains(F.col(text), F.lit(pattern)))
    n = F.size(F.filter(F.split(F.col(text), "\n"), lambda x: F.contains(x, F.lit(pattern)))).cast("bigint")
    return d.select(key, n.alias("matched_lines"), occurrences(F.col(text), pattern).alias("occurrences"))


def harvest(docs: DataFrame, terms: Sequence[str], min_matches: int = 1, max_files: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, matches): texts by the number of matches of all terms, most first, ties by key."""
    low = F.lower(F.col(text))
    total = sum((occurrences(low, t.lower()) for t in terms[1:]), occurrences(low, terms[0].lower()))
    d = docs.where(has_literals(F.col(text), [t.lower() for t in terms], every=False)).select(key, total.alias("matches")).where(F.col("matches") >= min_matches)
    return d.orderBy(F.desc("matches"), key).limit(max_files) if max_files else d


# ---- projections --------------------------------------------------------------------------

#: Patterns of secrets and addresses. Fixed values.
SECRET = r"\b(?:sk-[A-Za-z0-9_-]{12,}|ghp_[A-Za-z0-9]{20,}|gho_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{12,}|xox[baprs]-[A-Za-z0-9-]{10,})\b"
EMAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
PHONE = "\\+?\\d[\\d\\s().‐-]{7,16}\\d"
CARD = r"\b\d{13,19}\b"


def mask_simple(text: Column) -> Column:
    """Secrets, e-mail addresses and IP addresses masked."""
    out = text
    for pattern, label in ((SECRET, "[SECRET]"), (EMAIL, "[EMAIL]"), (IP, "[IP]")):
        out = F.regexp_replace(out, pattern, label)
    return out


def script_language(text: Column) -> Column:
    """The fallback of language detection: ru if Cyrillic is over a fifth of the letters, else en."""
    cyr = F.length(F.regexp_replace(text, "[^Ѐ-ӿ]", ""))
    lat = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when(cyr + lat == 0, "").when(cyr / (cyr + lat) > 0.2, "ru").otherwise("en")


def clean_text(text: Column) -> Column:
    """Lines without trailing blanks, runs of blank lines cut to one, outer blanks removed."""
    one = F.regexp_replace(text, r"\r\n?", "\n")
    tail = F.regexp_replace(one, r"[ \t\x0b\f ]+(?=\n|$)", "")
    runs = F.regexp_replace(tail, r"\n{3,}", "\n\n")
    return F.regexp_replace(runs, r"^\s+|\s+$", "")


def title_of(text: Column) -> Column:
    """The first line of three bytes or more, cut to 120 characters."""
    first = F.get(F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.octet_length(x) >= 3), 0)
    return F.coalesce(F.substring(first, 1, 120), F.lit(""))


def snippet(text: Column, term: str, width: int) -> Column:
    """A window of the flattened text around the first occurrence of a term."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    at = F.greatest(F.instr(F.lower(flat), term.lower()) - 1, F.lit(0))
    start = F.greatest(at - width // 2, F.lit(0))
    return F.substr(flat, (start + 1).cast("int"), F.lit(width))


#: Words of modality and their weights. Fixed values.
MARKERS: dict[str, float] = {
    "не должна": 2.0, "не должен": 2.0, "не должно": 2.0, "не должны": 2.0, "не может": 2.0, "не может быть": 2.0, "не допускается": 2.0, "не следует": 1.8, "запрещено": 2.0, "запрещается": 2.0,
    "никогда": 1.8, "ни при каких": 1.8, "never": 2.0, "must not": 2.0, "mustn't": 2.0, "cannot": 2.0, "can't": 1.8, "do not": 1.6, "don't": 1.6,
    "обязана": 1.5, "обязан": 1.5, "обязательство": 1.5, "обязательно": 1.4, "должна": 1.3, "должен": 1.3, "должны": 1.3, "требуется": 1.2, "следует": 1.0, "must": 1.5, "shall": 1.5, "required": 1.4, "mandatory": 1.4,
    "критично": 1.5, "критический": 1.4, "критическая": 1.4, "важно": 1.2, "важный": 1.1, "важная": 1.1, "срочно": 1.3, "critical": 1.5, "urgent": 1.3, "important": 1.2,
    "угроза": 1.2, "кризис": 1.2, "риск": 1.1, "опасность": 1.2, "авария": 1.2, "threat": 1.2, "crisis": 1.2, "risk": 1.1, "danger": 1.2, "failure": 1.1,
    "unsafe": 1.0, "todo": 1.0, "fixme": 1.2, "hack": 1.0, "deprecated": 1.3, "устарел": 1.2, "устаревший": 1.2, "panic!": 1.2, "unwrap()": 0.8, "метрика": 0.8, "metric": 0.8, "дедлайн": 1.0, "deadline": 1.0,
}
MARKER_PATTERN = "|".join(re.sub(r"([()!.?*+])", r"\\\1", m) for m in sorted(MARKERS, key=lambda m: (-len(m), m)))


def semantic_bonus(text: Column) -> Column:
    """The sum of the weights of all markers, the longest at each place."""
    weights = F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])
    found = F.regexp_extract_all(F.lower(text), F.lit(MARKER_PATTERN), F.lit(0))
    return F.round(F.aggregate(F.transform(found, lambda m: F.coalesce(weights[m], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x), 6)


#: Extensions of documents and of code; all others are data. Fixed values.
DOC_EXTENSIONS = "md markdown txt rst adoc org".split()
CODE_EXTENSIONS = "rs py c h cpp hpp cc hh hxx cxx inc inl js jsx ts tsx java go kt kts swift cs scala dart rb php pl lua sh bash zsh fish m mm zig v sv vh sql r jl s asm".split()


def path_class(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"[^/\\.]\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin(DOC_EXTENSIONS), "doc").when(ext.isin(CODE_EXTENSIONS), "code").otherwise("data")


def rank_tier(intent: str, signature_active: bool, matched: Column, path: Column) -> Column:
    """0 where the class of the file suits the query, 1 where it conflicts, 2 where a signature doesn't match."""
    if signature_active:
        return F.when(matched, 0).otherwise(2)
    against = {"code": "doc", "prose": "code"}.get(intent)
    return F.when(path_class(path) == against, 1).otherwise(0) if against else F.lit(0)


#: The scripts by code point ranges. Fixed values.
SCRIPTS = (("cyrillic", "Ѐ-ԯ"), ("latin", "A-Za-zÀ-ɏ"), ("greek", "Ͱ-Ͽ"), ("digit", "0-9"), ("space", "\\s"))


def script_counts(text: Column) -> list[Column]:
    return [F.length(F.regexp_replace(text, f"[^{chars}]", "")).alias(name) for name, chars in SCRIPTS]
