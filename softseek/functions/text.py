"""Column functions for post cleaning. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns must match exactly the text the cleaning rules name. They are written
# for Java with Unicode classes (U) and "\n" as the only line end (d). What the rules call whitespace
# is this list; what they call word characters is \w and every number.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_SET = r"\t\n\x0b\f\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{SPACE_SET}]"
NON_SPACE = f"[^{SPACE_SET}]"
LINE_SPACE = SPACE.replace(r"\n", "")
WORD = r"[[a-zA-Z0-9_][\w\p{N}]]"
ADDRESS_CHAR = r"[[a-zA-Z0-9_.+\-][\w\p{N}]]"
INTRO_CHAR = rf"[[a-zA-Z0-9_,.<>@\-(){SPACE_SET}][\w\p{{N}}]]"
WORD_EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# An opening without an end ($1) takes all that follows with it: no later one has an end either.
PGP_BLOCK = r"(?s)-----BEGIN PGP.*?-----END PGP[^-]*-----|(-----BEGIN PGP.*+)"
SIGNATURE = rf"\n--{SPACE}*\n"
REPLY_INTRO = rf"(?mUd)^(?i:In){SPACE}+(?i:article){SPACE}+.*?(?i:writes?|wrote){SPACE}*:.*$"
# A quote may begin with blank lines. A try begins at the first line start of a run of whitespace, not at
# every one: where the line before ends with text, or with text and blanks behind it. Looking back is
# bounded; bodies with longer blanks at a line end take the other form, in which a try begins at the end
# of the text before ($1), after the last match, or at the start.
TRAILING = 100
QUOTED_LINE = rf"(?md)^(?:(?<!{SPACE}\n)|(?<={SPACE}\n)(?<={NON_SPACE}{LINE_SPACE}{{1,{TRAILING}}}\n)){SPACE}*+>+.*$"
LONG_TRAILING = rf"\n(?<={LINE_SPACE}{{{TRAILING + 1}}}\n)"
QUOTED_LINE_AFTER_BLANKS = rf"(?md)(\A|\G\n|{NON_SPACE}{LINE_SPACE}*+\n){SPACE}*+>+.*$"
QUOTED_START = rf"(?md)^{LINE_SPACE}*+>"
DIVIDER = rf"(?md)^[{SPACE_SET}\-=*#~+_|]{{5,}}$"
BLANK_RUN = r"\n{3,}"
SUBJECT_PREFIX = rf"(?iU)^{SPACE}*(?:Re|Fwd|AW){SPACE}*:{SPACE}*"
SUBJECT_EDGE = "<>\"'"

# "<intro characters> wrote:" at the end of a line, from the first line start it can begin at. Intro
# characters include line ends but no colon, so only the run of them right before the colon matters.
# A try begins where such a run begins or where the last match ended, and $1 is what is left of the
# line there. Trying at every line start instead finds the same but rereads the run once per line.
ATTRIBUTION = (
    rf"(?mUd)(\G(?<=\n)|\A|(?:\G|(?<!{INTRO_CHAR}))[{INTRO_CHAR}&&[^\n]]*+\n)"
    rf"{INTRO_CHAR}+(?i:wrote|writes){SPACE}*:{SPACE}*$"
)
ATTRIBUTION_END = rf"(?mUd)(?i:wrote|writes){SPACE}*:{SPACE}*$"

# An address begins at the first word character of a run of address characters ($1 is what comes
# before it in the run), or right where the previous address ended.
EMAIL = (
    rf"(?U)(?:\G(?<=[a-zA-Z])|(?<!{ADDRESS_CHAR})([.+\-]*+)(?={WORD})){ADDRESS_CHAR}++"
    rf"@[\w\p{{N}}\-]+(?:\.[a-zA-Z]{{2,}})+{WORD_EDGE}"
)
# End of the fixed values.


def strip_text(text: Column) -> Column:
    """Remove whitespace of every kind at both ends (``trim`` removes blanks only)."""
    return F.trim(text, F.lit(SPACES))


def strip_pgp(body: Column) -> Column:
    return F.regexp_replace(body, PGP_BLOCK, "$1")


def cut_signature(body: Column) -> Column:
    return F.split(body, SIGNATURE, 2)[0]


def strip_reply_intro(body: Column) -> Column:
    return F.regexp_replace(body, REPLY_INTRO, "")


def strip_attribution(body: Column) -> Column:
    return F.regexp_replace(body, ATTRIBUTION, "$1")


def strip_quotes(body: Column) -> Column:
    plain = F.regexp_replace(body, QUOTED_LINE, "")
    return F.when(body.rlike(LONG_TRAILING), F.regexp_replace(body, QUOTED_LINE_AFTER_BLANKS, "$1")).otherwise(plain)


def strip_emails(body: Column) -> Column:
    return F.regexp_replace(body, EMAIL, "$1")


def strip_dividers(body: Column) -> Column:
    return F.regexp_replace(body, DIVIDER, "")


def collapse_blank(body: Column) -> Column:
    return strip_text(F.regexp_replace(body, BLANK_RUN, "\n\n"))


def count_matches(text: Column, pattern: str) -> Column:
    """Matches of a pattern that is never empty, in one pass over the text."""
    return F.when(text.isNotNull(), F.size(F.split(text, pattern, -1)) - 1)


def quote_ratio(body: Column) -> Column:
    """Quoted lines over non-blank lines; a body without a non-blank line counts as fully quoted."""
    lines = count_matches(body, rf"(?md)^{LINE_SPACE}*{NON_SPACE}")
    quoted = count_matches(body, rf"(?md)^{LINE_SPACE}*>")
    return F.when(body.isNotNull(), F.coalesce(F.try_divide(quoted, lines), F.lit(1.0)))


def word_count(text: Column) -> Column:
    """Whitespace-separated words: the gaps inside the stripped text, plus one."""
    bare = strip_text(text)
    return F.when(bare == "", 0).otherwise(count_matches(bare, f"{SPACE}+") + 1)


def compose_text(subject: Column, body: Column) -> Column:
    """Subject, blank line, body; only the body where there is no subject."""
    return F.when(subject.isNull(), body).otherwise(strip_text(F.concat(subject, F.lit("\n\n"), body)))


def truncate_text(text: Column, max_chars: int = 4000) -> Column:
    return F.substring(text, 1, max_chars)


def header_block(raw: Column) -> Column:
    return F.split(raw, "\n\n", 2)[0]


def body_block(raw: Column) -> Column:
    # A split without a second part yields null here, which stands for an empty body.
    return F.when(raw.isNull(), None).otherwise(F.coalesce(F.get(F.split(raw, "\n\n", 2), F.lit(1)), F.lit("")))


def _header_line(line: Column) -> tuple[Column, Column, Column]:
    """(has a colon, key, value) of one header line."""
    at = F.instr(line, ":")
    key = F.lower(strip_text(F.substring(line, F.lit(1), at - 1)))
    value = strip_text(F.substring(line, at + 1, F.length(line)))
    return at > 0, key, value


def _continues(line: Column, current: Column) -> Column:
    return (line.startswith(" ") | line.startswith("\t")) & (current != "")


def header_map(block: Column) -> Column:
    """All headers of a block as a map: folded lines joined, keys lower-cased, last duplicate kept."""

    def put(headers: Column, key: Column, value: Column) -> Column:
        rest = F.map_filter(headers, lambda k, _: k != key)
        return F.map_concat(rest, F.create_map(key, value))

    def step(acc: Column, line: Column) -> Column:
        is_header, key, value = _header_line(line)
        current, headers = acc["current"], acc["headers"]
        folded = F.concat(F.element_at(headers, current), F.lit(" "), strip_text(line))
        return (
            F.when(_continues(line, current), F.struct(current.alias("current"), put(headers, current, folded).alias("headers")))
            .when(is_header, F.struct(key.alias("current"), put(headers, key, value).alias("headers")))
            .otherwise(acc)
        )

    empty = F.struct(F.lit("").alias("current"), F.expr("cast(map() as map<string,string>)").alias("headers"))
    return F.aggregate(F.split(block, "\n"), empty, step)["headers"]


def header_fields(block: Column, names: tuple[str, ...]) -> Column:
    """Only the named headers, as a struct. Linear in the number of lines, unlike the whole map."""

    def step(acc: Column, line: Column) -> Column:
        is_header, key, value = _header_line(line)
        current = acc["current"]
        folds = _continues(line, current)
        fields = [
            F.when(folds & (current == name), F.concat(acc[name], F.lit(" "), strip_text(line)))
            .when(~folds & is_header & (key == name), value)
            .otherwise(acc[name])
            .alias(name)
            for name in names
        ]
        return F.struct(F.when(~folds & is_header, key).otherwise(current).alias("current"), *fields)

    empty = F.struct(F.lit("").alias("current"), *[F.lit(None).cast("string").alias(n) for n in names])
    return F.aggregate(F.split(block, "\n"), empty, step)


def clean_subject(subject: Column) -> Column:
    """Drop one reply prefix, blanks, then angle brackets and quotes at both ends; empty is null."""
    bare = strip_text(F.regexp_replace(strip_text(subject), SUBJECT_PREFIX, ""))
    return F.nullif(F.trim(bare, F.lit(SUBJECT_EDGE)), F.lit(""))


def parse_groups(newsgroups: Column) -> Column:
    """Comma-separated names, trimmed, empties dropped; order and duplicates kept."""
    names = F.transform(F.split(F.coalesce(newsgroups, F.lit("")), ","), strip_text)
    return F.filter(names, lambda g: g != "")
