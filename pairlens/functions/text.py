"""Text measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as CJK and as white space
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
SPACE = (
    r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
HAN = r"\x{4E00}-\x{9FFF}"
REQUESTED_LENGTH = rf"(?i)(\d[\d,]{{2,}})[{SPACE}]*(?:-|[{SPACE}])?(?:words?|字|tokens?)"
# constraints are searched in their JSON form, where other scripts are escaped
REQUESTED_IN_JSON = r"(?i)(\d[\d,]{2,}) *(?:-| )?(?:words?|tokens?)"


SPACE_CHARACTERS = "".join(
    chr(c)
    for low, high in (
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
        (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    )
    for c in range(low, high + 1)
)


def plain_spaces(text: Column) -> Column:
    """Every white-space character as a blank; a lookup per character, so the
    patterns that follow need only a small class."""
    return F.translate(text, SPACE_CHARACTERS, " " * len(SPACE_CHARACTERS))


def output_units(text: Column) -> Column:
    """CJK code points plus white-space separated runs of other text."""
    return F.regexp_count(text, F.lit(f"[{CJK}]")) + F.regexp_count(
        plain_spaces(text), F.lit(f"[^ {CJK}]+")
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(plain_spaces(text), F.lit("[^ ]+"))


def requested_length(text: Column, constraints_json: Column | None = None) -> Column:
    """Largest length asked for in a prompt and its constraints, 0 when none is."""
    found = F.regexp_extract_all(text, F.lit(REQUESTED_LENGTH), F.lit(1))
    if constraints_json is not None:
        listed = F.regexp_extract_all(constraints_json, F.lit(REQUESTED_IN_JSON), F.lit(1))
        found = F.concat(found, F.coalesce(listed, F.array().cast("array<string>")))
    numbers = F.transform(found, lambda m: F.regexp_replace(m, ",", "").cast("bigint"))
    return F.coalesce(F.array_max(numbers), F.lit(0).cast("bigint"))


def is_chinese(text: Column) -> Column:
    """Han characters outnumber Latin letters."""
    return F.regexp_count(text, F.lit(f"[{HAN}]")) > F.regexp_count(text, F.lit("[A-Za-z]"))


def strip(text: Column) -> Column:
    """Trim every kind of white space."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def event_name(value: Column) -> Column:
    """Lower case, other characters to underscores, trimmed."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", ""
    )


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def blind_id(condition: Column) -> Column:
    return F.concat(F.lit("blind-"), F.substring(sha256_hex(condition), 1, 16))


def pair_id(first: Column, second: Column) -> Column:
    """Unordered pair id."""
    joined = F.concat_ws("|", F.array_sort(F.array(first, second)))
    return F.concat(F.lit("pair-"), F.substring(sha256_hex(joined), 1, 16))


def presentation_order(pair: Column, seed: Column) -> Column:
    """First presentation of a pair, by the parity of a seeded digest."""
    digit = F.conv(F.right(sha256_hex(F.concat_ws(":", seed, pair)), F.lit(1)), 16, 10)
    return F.when(digit.cast("int") % 2 == 0, F.lit("A|B")).otherwise(F.lit("B|A"))


def prompt_category(prompt_id: Column) -> Column:
    """The id after its first dash and before its last underscore."""
    rest = F.regexp_extract(prompt_id, r"^[^-]*-([\s\S]*)$", 1)
    return F.regexp_replace(rest, r"_[^_]*$", "")


def numbered_list(items: Column) -> Column:
    """One text of numbered items; later lines of an item are indented."""
    return F.array_join(
        F.transform(
            items,
            lambda x, i: F.concat(
                (i + 1).cast("string"), F.lit(". "), F.replace(x, F.lit("\n"), F.lit("\n   "))
            ),
        ),
        "\n",
    )


# Agreement names of the group ratings
LIKERT = {
    "STRONGLY_DISAGREE": 1,
    "DISAGREE": 2,
    "SOMEWHAT_DISAGREE": 3,
    "NEUTRAL": 4,
    "SOMEWHAT_AGREE": 5,
    "AGREE": 6,
    "STRONGLY_AGREE": 7,
}
LIKERT_MIDPOINT = 4


def likert(name: Column) -> Column:
    """1 to 7, null for an unknown name."""
    result = F.lit(None).cast("int")
    for label, value in LIKERT.items():
        result = F.when(name == label, value).otherwise(result)
    return result


def parse_offset_timestamp(value: Column) -> Column:
    """ISO timestamp that states its offset, else null."""
    has_offset = value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)$")
    return F.when(has_offset, F.try_to_timestamp(value))


def parse_utc_timestamp(value: Column) -> Column:
    """ISO timestamp, read as UTC when it states no offset."""
    has_offset = value.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(has_offset, value).otherwise(F.concat(value, F.lit("Z"))))


def redact(text: Column, terms: dict[str, str]) -> Column:
    """Case-insensitive literal replacement of a small list of terms, in its order."""
    for term in terms:
        literal = "(?i)" + "".join(c if c.isalnum() or c == " " else "\\" + c for c in term)
        text = F.regexp_replace(text, literal, terms[term])
    return text
