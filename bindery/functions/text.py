"""Scalar text functions as Column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode whitespace, sentence terminators, identifier shapes and
# the countable-token pattern of the word metric.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a character class; listing it beats \s in Unicode mode.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# A run of whitespace. What can be none, nearly every character of a text, is told by three ranges before the class is tried.
_NO_SPACE = r"(?![!-~\u00a1-\u167f\u3001-\uffff])"
SPACE_RUN = rf"{_NO_SPACE}{SPACE}++"
# A run that is not one plain space already.
UNTIDY_SPACE = rf"{_NO_SPACE}(?: {SPACE_RUN}|(?! ){SPACE}++)"
TERMINATORS = "。！？!?"
QUOTE_TERMINATORS = "。！？"
# Unicode word edges are spelled out: \b in Unicode mode is far slower.
CONTENT_ID = r"(?<![\p{L}\p{N}_])content_[0-9a-f]+(?![\p{L}\p{N}_])"
KNOWLEDGE_ID = r"(?<![\p{L}\p{N}_])knowledge_[0-9a-f]+(?![\p{L}\p{N}_])"
CHAPTER_KEY = r"CHAPTER_[0-9]{3}"
SPOKEN_TOKEN = (
    "[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"
    "|[0-9]"
    "|[A-Za-z]+(?:['’\\-][A-Za-z]+)*"
)
MIN_WORDS = 300
MAX_WORDS = 10_000
DEFAULT_WORDS = (2_000, 2_500)
CONTENT_TYPES = {
    "解读": "解读",
    "解读类": "解读",
    "深度解读": "解读",
    "深度解读类": "解读",
    "书籍解读": "解读",
    "过渡": "过渡",
    "过渡类": "过渡",
    "过渡声音": "过渡",
    "承上启下": "过渡",
}
CASE_TITLE_WORDS = ("案", "故事", "事件", "纪念")
FULL_INPUT_CHARS = 100_000
UNIT_SEPARATOR = "\x1f"


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def nonblank(c: Column) -> Column:
    """Trimmed text, or null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def collapse_ws(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, UNTIDY_SPACE, " "))


def compact_text(c: Column) -> Column:
    return F.regexp_replace(c, SPACE_RUN, "")


def clean_for_match(c: Column) -> Column:
    # A lookahead and any character: a negated class of four ranges takes six times as long.
    return F.regexp_replace(c, r"(?![a-z0-9A-Z\u4e00-\u9fa5])(?s:.)", "")


def excerpt(c: Column, limit: int = 360) -> Column:
    return F.left(collapse_ws(c), F.lit(limit))


def restored_newlines(c: Column) -> Column:
    """How many literal backslash-n escapes a raw text holds."""
    return F.regexp_count(c, F.lit(r"\\n"))


def normalize_text(c: Column) -> Column:
    """Line-normalised text ending in exactly one newline."""
    unescaped = F.replace(F.replace(c, F.lit("\\r\\n"), F.lit("\n")), F.lit("\\n"), F.lit("\n"))
    unix = F.regexp_replace(unescaped, "\r\n|\r", "\n")
    tidy = F.regexp_replace(F.regexp_replace(unix, "[ \t]+\n", "\n"), "\n{4,}", "\n\n\n")
    return F.concat(strip(tidy), F.lit("\n"))


def _sentence_parts(c: Column, terminators: str) -> Column:
    return F.transform(F.split(c, f"(?<=[{terminators}])"), strip)


def extract_sentence(
    c: Column, low: int = 24, high: int = 180, fallback: int = 160, terminators: str = TERMINATORS
) -> Column:
    """First sentence of acceptable length, else a leading excerpt."""
    flat = F.regexp_replace(c, UNTIDY_SPACE, " ")
    fitting = F.filter(_sentence_parts(flat, terminators), lambda s: F.length(s).between(low, high))
    return F.coalesce(F.get(fitting, F.lit(0)), excerpt(c, fallback))


def first_quote(c: Column, low: int = 36, high: int = 120, terminators: str = QUOTE_TERMINATORS) -> Column:
    """First quotable sentence, null when there is none."""
    return F.get(
        F.filter(_sentence_parts(c, terminators), lambda s: F.length(s).between(low, high)), F.lit(0)
    )


def sentences(c: Column, terminators: str = TERMINATORS) -> Column:
    """Sentences with their terminators and an optional closing quote."""
    pattern = f"(?sd).+?(?:[{terminators}]+[”’\"']?|$)"
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), 0), strip)


def spoken_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(SPOKEN_TOKEN)), F.lit(0))


def word_count_check(c: Column, minimum: Column, maximum: Column) -> Column:
    """Struct of actual count, range verdict, signed delta and instruction."""
    n = spoken_words(c)
    return let(
        n,
        lambda a: F.struct(
            a.alias("actual"),
            a.between(minimum, maximum).alias("within_range"),
            F.when(a < minimum, minimum - a).when(a > maximum, maximum - a).otherwise(F.lit(0)).alias("delta"),
            F.when(a < minimum, F.format_string("需要增加至少 %d 字", minimum - a))
            .when(a > maximum, F.format_string("需要减少至少 %d 字", a - maximum))
            .otherwise(F.lit("当前字数已经位于目标范围内"))
            .alias("instruction"),
        ),
    )


def word_range_error(minimum: Column, maximum: Column) -> Column:
    """Error text for an unusable word range, null when it is usable."""
    return (
        F.when(minimum < MIN_WORDS, F.lit(f"每集最少字数不能低于 {MIN_WORDS}"))
        .when(maximum > MAX_WORDS, F.lit(f"每集最多字数不能超过 {MAX_WORDS}"))
        .when(minimum > maximum, F.lit("每集最少字数不能大于最多字数"))
    )


def check_word_range(minimum: int, maximum: int) -> None:
    """Argument check for one range held by the caller."""
    if minimum < MIN_WORDS or maximum > MAX_WORDS or minimum > maximum:
        raise ValueError(f"word range {minimum}-{maximum} is outside {MIN_WORDS}-{MAX_WORDS} or reversed")


def word_range_text(minimum: Column, maximum: Column) -> Column:
    return F.format_string(
        "每集 %d–%d 字；汉字和阿拉伯数字逐字计数，连续英文单词计 1 字，标点、Markdown 标记和空白不计入。",
        minimum,
        maximum,
    )


def extract_ids(c: Column, pattern: str) -> Column:
    """Distinct matches in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), 0))


def clean_planning_text(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, KNOWLEDGE_ID, ""), CONTENT_ID, "")
    return F.btrim(collapse_ws(bare), F.lit(" ，,；;"))


def strip_code_fence(c: Column) -> Column:
    trimmed = strip(c)
    bare = F.regexp_replace(trimmed, r"(?U)\A```(?:json)?\s*|\s*```\z", "")
    return F.when(trimmed.startswith("```"), strip(bare)).otherwise(trimmed)


def strip_think(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<think>.*?</think>", "")


def extract_fenced(c: Column) -> Column:
    """Body of the first text fence, else of the first json fence, else null."""

    def body(kind: str) -> Column:
        return F.when(
            F.regexp_like(c, F.lit(f"(?s)```{kind}.*?```")), F.regexp_extract(c, f"(?s)```{kind}(.*?)```", 1)
        )

    return strip(strip_think(strip(F.coalesce(body("text"), body("json")))))


def safe_name(c: Column, default: str = "未命名", limit: int = 80) -> Column:
    cleaned = F.btrim(F.regexp_replace(c, r'[\\/:*?"<>|]+', "_"), F.lit(" ."))
    return F.coalesce(F.nullif(F.left(cleaned, F.lit(limit)), F.lit("")), F.lit(default))


def footnote_markers(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\[\d+\]"))


# Chapter-number shapes in order of preference.
CHAPTER_NUMBER_SHAPES = (
    r"(第[零一二三四五六七八九十百千万\d]+章)",
    r"(前言|导论|序言|绪论|引言|结语|后记|参考文献)",
    r"(附录[零一二三四五六七八九十百千万\d]*)",
    r"(第[零一二三四五六七八九十百千万\d]+部分)",
)


def chapter_number(title: Column) -> Column:
    found = [F.nullif(F.regexp_extract(title, shape, 1), F.lit("")) for shape in CHAPTER_NUMBER_SHAPES]
    return F.coalesce(*found, title)


def map_lookup(key: Column, table: dict[str, str]) -> Column:
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(literal, key)


def normalize_content_type(c: Column, table: dict[str, str] | None = None) -> Column:
    """Canonical content type; null for a value outside the alias table."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), "[*_`]", "")
    return map_lookup(F.btrim(compact_text(bare), F.lit("：:；;，,。")), table or CONTENT_TYPES)


def ordinal_key(prefix: str, n: Column) -> Column:
    padded = F.when(n.between(0, 999), F.lpad(n.cast("string"), 3, "0")).otherwise(F.format_string("%03d", n))
    return F.concat(F.lit(f"{prefix}_"), padded)


def json_quote(c: Column) -> Column:
    """A string as a JSON literal."""
    packed = F.to_json(F.array(c))
    return F.substring(packed, F.lit(2), F.length(packed) - 2)


def frontmatter(*fields: tuple[str, Column, str]) -> Column:
    """YAML header from (key, value, 'text'|'number'|'list'); empty values are left out."""
    lines: list[Column] = []
    for key, value, kind in fields:
        if kind == "list":
            shown = F.concat(
                F.lit(f"{key}:\n"),
                F.array_join(F.transform(value, lambda x: F.concat(F.lit("  - "), x)), "\n"),
            )
            lines.append(F.when(F.coalesce(F.size(value), F.lit(0)) > 0, shown))
        elif kind == "number":
            lines.append(F.concat(F.lit(f"{key}: "), value.cast("string")))
        else:
            lines.append(F.when(value != "", F.concat(F.lit(f"{key}: "), json_quote(value))))
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


# Identity -----------------------------------------------------------------


def stable_id(namespace: str, *parts: Column) -> Column:
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.left(F.sha1(F.concat_ws(UNIT_SEPARATOR, F.lit(namespace), *texts)), F.lit(16))


def content_index(book: Column, section: Column, normalized: Column, occurrence: Column) -> Column:
    raw = F.concat_ws(
        UNIT_SEPARATOR, book.cast("string"), section.cast("string"), normalized, occurrence.cast("string")
    )
    return F.concat(F.lit("content_"), F.left(F.sha1(raw), F.lit(20)))


def legacy_content_index(section: Column) -> Column:
    return F.concat(F.lit("content_"), F.replace(section.cast("string"), F.lit("-"), F.lit("")))


def card_key(book: Column, kind: Column, body: Column, sources: Column) -> Column:
    """sha256 over the sorted-key JSON form of a card's identity."""
    listed = F.array_join(F.transform(sources, json_quote), ", ")
    canonical = F.concat(
        F.lit('{"body": '), json_quote(compact_text(body)),
        F.lit(', "book_id": '), json_quote(book.cast("string")),
        F.lit(', "kind": '), json_quote(kind),
        F.lit(', "sources": ['), listed, F.lit("]}"),
    )
    return F.sha2(canonical, 256)


def card_id(key: Column) -> Column:
    return F.concat(F.lit("knowledge_"), F.left(key, F.lit(24)))


def text_fingerprint(c: Column) -> Column:
    return F.sha2(collapse_ws(c), 256)


def signature(*inputs: Column) -> Column:
    """One digest over a canonical JSON of all inputs of a generation."""
    return F.sha2(F.to_json(F.struct(*inputs)), 256)


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def parse_iso(c: Column) -> Column:
    return F.try_to_timestamp(c)


def size_tier(full: Column, compact: Column, limit: int = FULL_INPUT_CHARS) -> Column:
    return (
        F.when(full <= limit, F.lit("full")).when(compact <= limit, F.lit("compact")).otherwise(F.lit("compressed"))
    )


def title_flag(title: Column, words: tuple[str, ...] = CASE_TITLE_WORDS) -> Column:
    return F.regexp_like(title, F.lit("|".join(words)))


def uuid5_hex(namespace_hex: str, name: Column) -> Column:
    """Name-based identifier (RFC 4122 version 5) as 32 hex digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(
        F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15)
    )


# Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def prompt_version_id(stage: Column, version: Column, prefix: str) -> Column:
    """Stable id of a built-in prompt version."""
    return uuid5_hex(URL_NAMESPACE, F.concat_ws(":", F.lit(prefix), stage, version))
