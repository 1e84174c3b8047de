"""Notation made speakable: Column -> Column functions, chained by sanitize()."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import dictionaries as D

BLANK = r"[\s\x1c-\x1f]"
CODE_NOTICE = "trecho de código omitido"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def cut(c: Column, pattern: str) -> Column:
    """split(c, pattern, -1). Splitting compiles its pattern for every row, replacing does not; so texts are cut at what a match is replaced by."""
    nul = "\x00"
    return let(c, lambda t: F.when(F.contains(t, F.lit(nul)), F.split(t, pattern, -1)).otherwise(F.split(F.regexp_replace(t, pattern, nul), nul, -1)))


def _put(t: Column, pattern: str, said: Callable[[Column], Column]) -> Column:
    """t with each match put through said. Matches are set between NULs and cut out there; a text that holds a NUL itself is cut by split."""
    nul = "\x00"
    told = lambda m: F.coalesce(said(m), m)
    parts = F.split(F.regexp_replace(t, pattern, f"{nul}$0{nul}"), nul, -1)
    words = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), told)
    apart = F.zip_with(F.split(t, pattern, -1), words, lambda gap, word: F.concat(gap, F.coalesce(word, F.lit(""))))
    return F.array_join(F.when(F.contains(t, F.lit(nul)), apart).otherwise(F.transform(parts, lambda m, i: F.when(i % 2 == 1, told(m)).otherwise(m))), "")


def folded_flags(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], block: int = 500) -> Column:
    """array<boolean>: for each item the flag of step(state, item) -> (state, flag), in order. Flags are gathered in blocks, so that work stays near linear."""
    none = F.array().cast("array<boolean>")

    def put(all_items: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            new, flag = step(acc.state, x)
            return F.struct(new.alias("state"), F.concat(acc.flags, F.array(flag)).alias("flags"))

        def part(acc: Column, first: Column) -> Column:
            done = F.aggregate(F.slice(all_items, first, F.lit(block)), F.struct(acc.state.alias("state"), none.alias("flags")), one)
            return let(done, lambda d: F.struct(d.state.alias("state"), F.concat(acc.all, F.array(d.flags)).alias("all")))

        start = F.struct(state.alias("state"), F.array().cast("array<array<boolean>>").alias("all"))
        return F.when(F.size(all_items) > 0, F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(all_items), F.lit(block)), start, part, lambda acc: acc.all))).otherwise(none)

    return let(items, put)


def replaced(c: Column, pattern: str, said: Callable[[Column], Column]) -> Column:
    """c with each match of the pattern put through said (null leaves it): one pass, so what is put in isn't read again."""
    return let(c, lambda t: F.when(t.rlike(pattern), _put(t, pattern, said)).otherwise(t))


def words_of(dictionary: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in dictionary.items() for x in (k, v)])


def any_of(words) -> str:
    """An alternation of the words, longer ones first."""
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def prefixed(words) -> str:
    """An alternation of the words, longest match first, in which common beginnings stand once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    out = "|".join(re.escape(h) + (f"(?:{prefixed(tails)})" if len(set(tails)) > 1 or "" in tails and any(tails) else prefixed(tails)) for h, tails in sorted(heads.items()))
    return f"{out}|" if "" in words else out


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+\z", "")


def _lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def code_blocks(c: Column) -> Column:
    """A fenced block becomes a notice; so does a block that never closes. Fences of the other kind inside a block go with it."""
    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        fence = F.regexp_extract(strip(line), r"(?U)^(`{3,}|~{3,})\s*\w*$", 1).substr(1, 1)
        closes = (acc.fence != "") & (fence == acc.fence)
        out = F.when(closes, F.concat(acc.out, F.array(F.lit(CODE_NOTICE)))).when((acc.fence == "") & (fence == ""), F.concat(acc.out, F.array(line))).otherwise(acc.out)
        return F.struct(F.when(closes, F.lit("")).when(acc.fence == "", fence).otherwise(acc.fence).alias("fence"), out.alias("out"))

    def finish(acc: Column) -> Column:
        return F.array_join(F.when(acc.fence != "", F.concat(acc.out, F.array(F.lit(CODE_NOTICE)))).otherwise(acc.out), "\n")

    return let(c, lambda t: F.when(t.rlike("```|~~~"), F.aggregate(_lines(t), start, step, finish)).otherwise(t))


def links(c: Column) -> Column:
    """URLs become "link", keeping the punctuation that ends them; then e-mail addresses become a phrase."""
    urls = lambda t: F.regexp_replace(t, r"""(?iU)https?://(?:([^\s<>'"]*[^\s<>'".,;:!?])([.,;:!?]*)|([.,;:!?]+))""", "link$2$3")
    mails = lambda t: F.regexp_replace(t, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "endereço de e-mail")
    c = let(c, lambda t: F.when(F.contains(t, F.lit("://")), urls(t)).otherwise(t))
    return let(c, lambda t: F.when(F.contains(t, F.lit("@")), mails(t)).otherwise(t))


def emphasis(c: Column) -> Column:
    plain = lambda t: F.regexp_replace(t, r"(?dU)\*\*(.+?)\*\*|\*([^\s*][^*]*?)\*|`([^`]+?)`", "$1$2$3")
    return let(c, lambda t: F.when(t.rlike("[*`]"), plain(t)).otherwise(t))


def list_numbers(c: Column) -> Column:
    """A line's number goes if the line before or after is a list item too."""
    numbered, item = r"(?U)^\d{1,3}[.)]\s+(?=\S)", r"(?U)^(?:\d{1,3}[.)]|[-*+])\s+\S"

    def cut(lines: Column) -> Column:
        near = lambda i: F.coalesce(F.get(lines, i).rlike(item), F.lit(False))
        one = lambda line, i: F.when(line.rlike(numbered) & (((i > 0) & near(i - 1)) | near(i + 1)), F.regexp_replace(line, numbered, "")).otherwise(line)
        return F.array_join(F.transform(lines, one), "\n")

    return let(c, lambda t: F.when(t.rlike(r"(?Um)^\d"), let(_lines(t), cut)).otherwise(t))


def line_markers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?dUm)^(?:#{1,6}\s*|>\s?|[-*+]\s+)", "")


def table_rows(c: Column) -> Column:
    """Separator rows go; other rows that start with a pipe become their cells, joined by commas."""

    def row(line: Column) -> Column:
        bare = strip(line)
        separator = bare.rlike(r"^\|[|:\x20-]*\|$") & F.contains(bare, F.lit("-"))
        cells = F.filter(F.transform(F.split(bare, r"\|"), strip), lambda x: x != "")
        return F.when(separator, F.lit(None).cast("string")).when(bare.startswith("|"), F.array_join(cells, ", ")).otherwise(line)

    rows = lambda t: F.array_join(F.filter(F.transform(_lines(t), row), lambda x: x.isNotNull()), "\n")
    return let(c, lambda t: F.when(F.contains(t, F.lit("|")), rows(t)).otherwise(t))


def currency(c: Column) -> Column:
    """The sign's word goes behind the number."""
    signs, number = any_of(sign for sign, _ in D.CURRENCIES), r"\d[\d.,]*\d|\d"
    words = words_of(dict(D.CURRENCIES))
    said = lambda m: F.concat(F.regexp_extract(m, rf"(?U)({number})", 1), F.lit(" "), words[F.regexp_extract(m, f"^({signs})", 1)])
    return replaced(c, rf"(?U)(?:{signs})\s*(?:{number})", said)


def symbols(c: Column) -> Column:
    words = words_of(D.SYMBOLS)
    return replaced(c, f"[{''.join(D.SYMBOLS)}]", lambda m: words[m])


def abbreviations(c: Column) -> Column:
    words = words_of(D.ABBREVIATIONS)
    return replaced(c, rf"(?iuU)(?<!\w)(?:{any_of(D.ABBREVIATIONS)})\.", lambda m: words[F.lower(F.regexp_replace(m, r"\.$", ""))])


def hours(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)(?<!\w)(\d{1,2})h(\d{2})(?!\d)", "$1 e $2"), r"(?U)(?<!\w)(\d{1,2})h(?!\w)", "$1 horas")


def dates(c: Column) -> Column:
    """A month that isn't one leaves the date as it is."""

    def said(m: Column) -> Column:
        parts = F.split(m, "/")
        name = F.get(F.array(*[F.lit(x) for x in D.MONTHS]), F.get(parts, F.lit(1)).try_cast("int") - 1)
        return F.coalesce(F.concat(F.get(parts, F.lit(0)), F.lit(" de "), name, F.lit(" de "), F.get(parts, F.lit(2))), m)

    return replaced(c, r"(?U)(?<!\w)\d{1,2}/\d{1,2}/\d{2,4}(?!\w)", said)


def ranges(c: Column) -> Column:
    c = F.regexp_replace(c, rf"(?iuU)(?<!\w)({'|'.join(D.RANGE_NOUNS)})(\s+)(\d+)-(\d+)(?!\w)", "$1$2$3 a $4")
    return F.regexp_replace(c, r"(?U)(?<=\d)\s*–\s*(?=\d)", " a ")


MARKUP = (code_blocks, links, emphasis, list_numbers, line_markers, table_rows)
NOTATION = (currency, symbols, abbreviations, hours, dates, ranges)
ORDER = (*MARKUP, *NOTATION)


def in_order(c: Column, steps: tuple[Callable[[Column], Column], ...] = ORDER) -> Column:
    """The steps one after another, each computed once: what sanitize() gives, and how texts are done whose tokens touch each other."""
    return reduce(lambda x, f: let(x, f), steps, c)


#: Without one of these a text has no markup.
MARKED = r"(?mU)^[#>*+\d-]|[*`@|]|://|~~~"

_SIGN, _NUMBER = rf"(?:{any_of(sign for sign, _ in D.CURRENCIES)})", r"(?:\d[\d.,]*\d|\d)"
_SYMBOL = "".join(D.SYMBOLS)
_RANGED = [short for short, word in D.ABBREVIATIONS.items() if word in D.RANGE_NOUNS]
_NO_WORD = rf"(?![\w{_SYMBOL}])"  # a symbol counts as a letter, for its word will stand there
#: Every token of NOTATION, in the text as it is before any of them is put in words. Plain letters are passed over by the two tests in front.
TOKEN = (
    rf"(?U)(?![a-z])(?:(?=[RU$€£]){_SIGN}\s*{_NUMBER}|(?![\x00-\x25\x27-\x7f])[{_SYMBOL}]|[%&]|(?=[\s–])(?<=\d)\s*–\s*(?=\d))"
    rf"|(?<![a-z])(?<![\w{_SYMBOL}])(?:\d{{1,2}}(?:h(?:\d{{2}}(?!\d)|{_NO_WORD})|/\d{{1,2}}/\d{{2,4}}{_NO_WORD})"
    rf"|(?iu:(?:{prefixed(_RANGED)})\.\s+\d+-\d+{_NO_WORD}|(?:{prefixed(D.ABBREVIATIONS)})\.|(?:{prefixed(D.RANGE_NOUNS)})\s+\d+-\d+{_NO_WORD}))"
)
#: Where what one token becomes could make, or unmake, another: signs behind a letter, digit or dash, dashes behind money, words that
#: grow together with a symbol's or an abbreviation's, ranges and hours that run into hours and dates.
TANGLED = (
    rf"(?U)h\d{{2}}[h/]|(?![a-z])(?:(?=[RU$€£])(?:(?<=[\w/–-])(?<!R(?=\$))(?<!US(?=\$)){_SIGN}\s*\d|{_SIGN}\s*{_NUMBER}\s*–)|–\s+{_SIGN}\s*\d"
    rf"|-\d+[h/]|\.(?:\d{{1,2}}[h/]|\w+\s+\d+-\d)|[%&]\w|(?![\x00-\x7f])[{_SYMBOL}]\w|§\s+\d+-\d)"
)


def _token_words(m: Column) -> Column:
    """What a token of TOKEN becomes; null leaves it."""
    short, month = words_of(D.ABBREVIATIONS), F.get(F.array(*[F.lit(x) for x in D.MONTHS]), F.split_part(m, F.lit("/"), F.lit(2)).try_cast("int") - 1)
    symbol, said = words_of(D.SYMBOLS)[m], lambda name: short[F.lower(name)]
    pence = F.regexp_extract(m, rf"(?U)^({_SIGN})\s*(.*)$", 2)
    money = F.concat(pence, F.lit(" "), words_of(dict(D.CURRENCIES))[F.regexp_extract(m, f"^({_SIGN})", 1)])
    ranged = F.replace(m, F.lit("-"), F.lit(" a "))
    return (
        F.when(symbol.isNotNull(), symbol)
        .when(F.contains(m, F.lit("/")), F.concat(F.split_part(m, F.lit("/"), F.lit(1)), F.lit(" de "), month, F.lit(" de "), F.split_part(m, F.lit("/"), F.lit(3))))
        .when(F.contains(m, F.lit("–")), F.lit(" a "))
        .when(m.endswith("."), said(F.substring_index(m, ".", 1)))
        .when(m.rlike(f"^{_SIGN}"), money)
        .when(m.endswith("h"), F.concat(F.substring_index(m, "h", 1), F.lit(" horas")))
        .when(m.rlike(r"(?U)^\d"), F.replace(m, F.lit("h"), F.lit(" e ")))
        .when(F.contains(m, F.lit(".")), F.concat(said(F.substring_index(m, ".", 1)), F.substring_index(ranged, ".", -1)))
        .otherwise(ranged)
    )


def notation(c: Column) -> Column:
    """All of NOTATION in one scan; a text in which tokens touch each other goes through them in order."""
    return let(c, lambda t: F.when(~t.rlike(TOKEN), t).when(t.rlike(TANGLED), in_order(t, NOTATION)).otherwise(_put(t, TOKEN, _token_words)))


def sanitize(c: Column) -> Column:
    """All of ORDER: markup, where there is any, in its steps; notation in one scan."""
    return notation(let(c, lambda t: F.when(t.rlike(MARKED), in_order(t, MARKUP)).otherwise(t)))


def substitute_terms(c: Column, terms: dict[str, str]) -> Column:
    """Whole words replaced through a dictionary in one pass, whatever their case, the longest first; an empty dictionary changes nothing."""
    if not terms:
        return c
    words = words_of({k.lower(): v for k, v in terms.items()})
    return replaced(c, rf"(?iuU)(?<!\w)(?:{any_of(terms)})(?!\w)", lambda m: words[F.lower(m)])
