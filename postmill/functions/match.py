"""Composable full-text predicates over posting columns.

A token is a run of letters, digits and private-use characters; case and
diacritics do not count. Terms, phrases, prefixes and anchored terms compile to
one regular expression that scans the stored text where it lies, so no token
array is built or shuffled; only proximity needs token positions, and those are
computed for rows that already hold every phrase.

Plain ASCII text, which one length comparison detects, is scanned with a short
expression of single-byte classes; other text with the full one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence
from functools import lru_cache, reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import let

COLUMNS = ("title", "description", "company", "location")

# The characters of a token, and the marks ignored inside one.
MARKS = r"\x{300}-\x{36F}"
WORD = rf"\p{{L}}\p{{N}}\p{{Co}}{MARKS}"
ASCII_WORD = "a-zA-Z0-9"
TOKEN = rf"[{WORD}]+"


def _base(char: str) -> str:
    plain = unicodedata.normalize("NFD", char.lower())
    return "".join(c for c in plain if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _variants() -> dict[str, str]:
    """Letters that fold to one base character, by rule over the Unicode data."""
    found: dict[str, list[str]] = {}
    for code in range(0x80, 0x20000):
        char = chr(code)
        if char.isalpha():
            base = _base(char)
            if len(base) == 1 and base != char:
                found.setdefault(base, []).append(char)
    return {base: "".join(chars) for base, chars in found.items()}


def _ranges(chars: set[str]) -> str:
    """Members of a character class, neighbours joined to ranges."""
    codes, out = sorted(ord(c) for c in chars), []
    for code in codes:
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out)


def _cases(char: str) -> set[str]:
    return {char, char.upper()} if len(char.upper()) == 1 else {char}


def _head_class(chars: Iterable[str], ascii_text: bool) -> str:
    """Any of some folded characters, as one class of ASCII and one of other letters."""
    cases = set().union(*(_cases(c) for c in chars))
    if not ascii_text:
        cases |= set("".join(_variants().get(c, "") for c in chars))
    plain, other = {c for c in cases if c < "\x80"}, {c for c in cases if c >= "\x80"}
    ways = [f"[{_ranges(plain)}]"] if plain else []
    if other:
        ways.append(rf"(?=[^\x00-\x7F])[{_ranges(other)}]")
    return f"(?:{'|'.join(ways)})"


def _char_class(char: str, ascii_text: bool) -> str:
    """One folded character: in ASCII text its cases, else all its variants.

    A variant outside ASCII is looked for only where the text has one.
    """
    cases = _cases(char)
    if ascii_text:
        return f"[{_ranges(cases)}]"
    variants = cases | set(_variants().get(char, ""))
    plain, other = {c for c in variants if c < "\x80"}, {c for c in variants if c >= "\x80"}
    if not plain:
        body = f"[{_ranges(other)}]"
    elif not other:
        body = f"[{_ranges(plain)}]"
    else:
        body = rf"(?:[{_ranges(plain)}]|(?=[^\x00-\x7F])[{_ranges(other)}])"
    return f"{body}[{MARKS}]*" if char.isalpha() else body


def fold_tokens(text: str) -> list[str]:
    """Tokens of a query text, folded like the searched text."""
    marked = "".join(
        c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " "
        for c in "".join(_base(c) for c in text if not unicodedata.combining(c))
    )
    return marked.split()


def _token_pattern(token: str, ascii_text: bool = False) -> str:
    return "".join(_char_class(c, ascii_text) for c in token)


def _pattern(tokens: list[str], prefix: bool, initial: bool, ascii_text: bool) -> str:
    """Expression of adjacent tokens.

    The look behind for a token start comes after the first character, so most
    positions are left after one class test.
    """
    word = ASCII_WORD if ascii_text else WORD
    parts = [_token_pattern(t, ascii_text) for t in tokens]
    first = _char_class(tokens[0][0], ascii_text).removesuffix(f"[{MARKS}]*")
    if initial:
        parts[0] = f"^[^{word}]*{parts[0]}"
    else:
        parts[0] = f"{first}(?<![{word}]{first}){parts[0].removeprefix(first)}"
    return f"[^{word}]+".join(parts) + ("" if prefix else f"(?![{word}])")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _resolve(cols: str | Iterable[str] | None) -> tuple[str, ...]:
    names = COLUMNS if cols is None else (cols,) if isinstance(cols, str) else tuple(cols)
    unknown = [c for c in names if c not in COLUMNS]
    if unknown or not names:
        raise ValueError(f"unknown search columns: {', '.join(unknown) or 'none given'}")
    return names


def excluding(*cols: str) -> tuple[str, ...]:
    """Every searchable column but the named ones."""
    dropped = _resolve(cols)
    return tuple(c for c in COLUMNS if c not in dropped)


def phrase(text: str, cols=None, *, prefix: bool = False, initial: bool = False) -> Column:
    """Adjacent tokens inside one column.

    ``prefix`` lets the last token be the start of a longer one; ``initial``
    asks the phrase to open its column. A phrase without tokens matches nothing.
    """
    names, tokens = _resolve(cols), fold_tokens(text)
    if not tokens:
        return F.lit(False)
    full = _pattern(tokens, prefix, initial, False)
    plain = _pattern(tokens, prefix, initial, True) if "".join(tokens).isascii() else None

    def found(name: str) -> Column:
        c = F.coalesce(F.col(name), F.lit(""))
        in_plain = F.rlike(c, F.lit(plain)) if plain is not None else F.lit(False)
        return F.when(is_ascii(c), in_plain).otherwise(F.rlike(c, F.lit(full)))

    return any_of([found(n) for n in names])


def _trie(phrases: Iterable[tuple[str, bool]]) -> dict:
    """Folded phrases as nested nodes; a space is a gap between tokens. Ends are marked by whether they are prefixes."""
    root: dict = {}
    for text, open_ended in phrases:
        node = root
        for char in text:
            node = node.setdefault(char, {})
        node.setdefault("ends", set()).add(open_ended)
    return root


def _trie_pattern(node: dict, ascii_text: bool) -> str:
    """Expression of the longest phrase of a trie at a place, whole tokens at its end."""
    word = ASCII_WORD if ascii_text else WORD
    ways = []
    for char, below in node.items():
        if char == "ends":
            continue
        first = f"[^{word}]+" if char == " " else _char_class(char, ascii_text)
        ways.append(first + _trie_pattern(below, ascii_text))
    ends = node.get("ends", set())
    if True in ends:
        ways.append(f"[{word}]*+")
    elif ends:
        ways.append(f"(?![{word}])")
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


class Keywords:
    """Many phrases that are looked for in one pass over each column.

    All phrases form one trie-shaped expression, which finds the longest of them at every
    token. ``scan`` adds what was found, a short list per column; ``has`` reads a phrase
    from these lists, so a Boolean tree of any size costs one scan of the text.
    """

    def __init__(self, phrases: Iterable[str], prefixes: Iterable[str] = (), cols=None, name: str = "_found") -> None:
        self.names, self.name = _resolve(cols), name
        folded = [(" ".join(fold_tokens(t)), False) for t in phrases]
        folded += [(" ".join(fold_tokens(t)), True) for t in prefixes]
        self.known = {f for f in folded if f[0]}

    def _pattern(self, ascii_text: bool) -> str | None:
        """Expression of what is met at a token; null if none of the phrases is in ASCII letters."""
        fitting = sorted(f for f in self.known if f[0].isascii() or not ascii_text)
        if not fitting:
            return None
        word, heads = ASCII_WORD if ascii_text else WORD, sorted({f[0][0] for f in fitting})
        # Most places are left after one class test, and most others by what stands before.
        start = rf"(?={_head_class(heads, ascii_text)})(?<![{word}])"
        return f"{start}(?=({_trie_pattern(_trie(fitting), ascii_text)}))"

    def _found(self, column: str) -> Column:
        c, none = F.coalesce(F.col(column), F.lit("")), F.array().cast("array<string>")
        plain, full = self._pattern(True), self._pattern(False)

        def met(pattern: str | None) -> Column:
            return none if pattern is None else F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)))

        return F.when(is_ascii(c), met(plain)).otherwise(met(full))

    def _all_found(self) -> Column:
        return F.struct(*[self._found(c).alias(c) for c in self.names])

    def scan(self, df):
        """``df`` with what was found in each column, to be stored and read by ``has``."""
        return df.withColumn(self.name, self._all_found())

    def predicate(self, tree) -> Column:
        """``tree``, a function of this set's ``has`` that builds a predicate, over one scan of the text.

        The lists found are bound once: a filter on a column made by ``scan`` would be
        pushed below it and scan the text for each phrase of the tree.
        """
        def bound(found: Column) -> Column:
            def has(text: str, cols=None, *, prefix: bool = False) -> Column:
                return self.has(text, cols, prefix=prefix, found=found)

            return tree(has)

        return let(self._all_found(), bound)

    def has(self, text: str, cols=None, *, prefix: bool = False, found: Column | None = None) -> Column:
        """Whether a phrase of the set was found in one of the columns scanned."""
        found = F.col(self.name) if found is None else found
        wanted = (" ".join(fold_tokens(text)), prefix)
        names = self.names if cols is None else _resolve(cols)
        if set(names) - set(self.names):
            raise ValueError(f"columns not scanned: {', '.join(sorted(set(names) - set(self.names)))}")
        if not wanted[0]:
            return F.lit(False)
        if wanted not in self.known:
            raise ValueError(f"phrase not in the set: {text}")
        # What was found begins with the phrase if the phrase was met there.
        pattern = f"^{_pattern(wanted[0].split(), prefix, False, False)}"
        return any_of([F.exists(found[c], lambda x: F.rlike(x, F.lit(pattern))) for c in names])

    def any(self) -> Column:
        """Whether any phrase of the set was found."""
        return any_of([F.size(F.col(self.name)[c]) > 0 for c in self.names])


def any_phrase(phrases: Iterable[str], cols=None) -> Column:
    """Whether a text has any of many phrases, by one expression per column."""
    keywords = Keywords(phrases, cols=cols)
    if not keywords.known:
        return F.lit(False)
    plain, full = keywords._pattern(True), keywords._pattern(False)

    def found(name: str) -> Column:
        c = F.coalesce(F.col(name), F.lit(""))
        in_plain = F.rlike(c, F.lit(plain)) if plain is not None else F.lit(False)
        return F.when(is_ascii(c), in_plain).otherwise(F.rlike(c, F.lit(full)))

    return any_of([found(n) for n in keywords.names])


def term(text: str, cols=None) -> Column:
    return phrase(text, cols)


def prefix(text: str, cols=None) -> Column:
    return phrase(text, cols, prefix=True)


def initial(text: str, cols=None) -> Column:
    return phrase(text, cols, initial=True)


def all_of(predicates: Sequence[Column]) -> Column:
    return reduce(and_, predicates, F.lit(True))


def any_of(predicates: Sequence[Column]) -> Column:
    return reduce(or_, predicates)


def words(text: str, cols=None) -> Column:
    """Adjacent query words: all must match, each in any column."""
    return all_of([term(t, cols) for t in fold_tokens(text)])


def near(phrases: Sequence[str], n: int = 10, cols=None) -> Column:
    """All phrases in one column, at most ``n`` tokens before the last one."""
    wanted = [fold_tokens(p) for p in phrases]
    if len(wanted) < 2 or not all(wanted):
        raise ValueError("near needs at least two phrases with tokens")

    def starts(tokens: Column, parts: list[str]) -> Column:
        pattern = "^" + " ".join(_token_pattern(p) for p in parts) + "$"

        def position(token: Column, i: Column) -> Column:
            here = token
            if len(parts) > 1:
                here = F.array_join(F.slice(tokens, i + 1, len(parts)), " ")
            return F.when(F.rlike(here, F.lit(pattern)), i)

        return F.filter(F.transform(tokens, position), lambda i: i.isNotNull())

    def close(name: str) -> Column:
        text = F.coalesce(F.col(name), F.lit(""))
        tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
        found = F.struct(*[starts(tokens, p).alias(f"p{k}") for k, p in enumerate(wanted)])

        def around(positions: Column) -> Column:
            groups = [positions[f"p{k}"] for k in range(len(wanted))]

            def reaches(group: Column, size: int, last: Column) -> Column:
                return F.exists(group, lambda s: (s <= last) & (s + size + n >= last))

            def holds(last: Column) -> Column:
                return all_of([reaches(g, len(p), last) for g, p in zip(groups, wanted)])

            return F.exists(F.concat(*groups), holds)

        present = all_of([phrase(" ".join(p), name) for p in wanted])
        checked = F.transform(F.array(found), around)[0]
        return F.when(present, checked).otherwise(F.lit(False))

    return any_of([close(c) for c in _resolve(cols)])


def keyword_lines(text: str) -> list[str]:
    """Lines of a keyword document, without blank and '#' lines."""
    lines = (line.strip() for line in text.splitlines())
    return [line for line in lines if line and not line.startswith("#")]


def matching(df, predicate: Column | None):
    """Rows matching a predicate; all rows without one."""
    return df if predicate is None else df.filter(predicate)
