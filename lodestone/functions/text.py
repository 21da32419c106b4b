"""Text as Catalyst expressions: tokenizers, estimates, normal forms for matching, levels and markers."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let

# The patterns that define tokens.
WORD = r"[\p{L}\p{N}]+(?:[-_.][\p{L}\p{N}]+)*"
PLAIN_WORD = r"[\p{L}\p{N}]+"
NOT_PLAIN = r"[^\p{L}\p{N}]+"
DOTTED_NUMBER = r"^\d+(?:\.\d+)+$"
CAMEL = r"(?<=\p{Ll}|\p{N})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"

SIMPLE = r"^\p{Lu}?[\p{Ll}]+$|^\p{Lu}+$|^\p{N}+$"
#: Where a text has none of these, its tokens are the words of the lowered text: no compound, no camel case, and no
#: letter whose lower case depends on what follows or is no letter only. All but a few characters fail the first test.
SPECIAL = r"(?=[-_.\p{Lu}])(?:(?<=[\p{L}\p{N}])[-_.](?=[\p{L}\p{N}])|(?<=[\p{Ll}\p{N}])\p{Lu}|(?<=\p{Lu})\p{Lu}(?=\p{Ll})|[\x{130}\x{3A3}])"
#: Only texts with characters beyond these can change when they are composed.
COMPOSED = r"[^\x{0}-\x{2FF}\x{2002}-\x{20CF}]"

#: In texts without these, all characters beyond ASCII are letters, in lower case too, and none changes when composed.
#: Few characters pass the first test; the second alone is slow.
ODD = r"(?=[^\x{0}-\x{7F}])[^\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}]"

# Characters that count as the same when quotes are matched.
SAME = {"'": "‘’‚‛′", '"': "“”„‟″", "-": "‐‑‒–—―−"}
ELLIPSIS = "…"
#: White space of all scripts, and the byte order mark.
WHITE = r"(?U)[\s\x{FEFF}]+"
NOT_WHITE = r"(?U)[^\s\x{FEFF}]"

CHARS_PER_TOKEN = 3.5


def tokens(text: Column) -> Column:
    """Lower-cased words of the composed text; of compounds also their parts, and of those the camel-case pieces. Order
    and repeats stay."""
    composed = nfc(F.coalesce(text, F.lit("")))

    none = F.array().cast("array<string>")

    def of_part(part: Column) -> Column:
        return F.when(part.rlike(CAMEL), F.transform(F.split(part, CAMEL), F.lower)).otherwise(none)

    def of_parts(parts: Column) -> Column:
        return F.concat(F.when(F.size(parts) > 1, F.transform(parts, F.lower)).otherwise(none), F.flatten(F.transform(parts, of_part)))

    def of_word(word: Column) -> Column:
        own = F.array(F.lower(word))
        # most words are simple; what the others add is computed from parts that are split once
        compound = F.when(word.rlike(DOTTED_NUMBER), own).otherwise(F.concat(own, let(F.split(word, "[-_.]"), of_parts)))
        return F.when(word.rlike(SIMPLE), own).otherwise(compound)

    plain = F.regexp_extract_all(F.lower(composed), F.lit(PLAIN_WORD), F.lit(0))
    return F.when(composed.rlike(SPECIAL), F.flatten(F.transform(F.regexp_extract_all(composed, F.lit(WORD), F.lit(0)), of_word))).otherwise(plain)


def plain_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and numbers, nothing else."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(PLAIN_WORD), F.lit(0))


def lines(text: Column, odd: Column) -> tuple[Column, Column]:
    """(`plain_tokens`, `tokens`) as texts, no arrays: of the first, runs of ASCII letters and digits and of all other
    characters beyond ASCII are the tokens; the second are joined by single spaces, and null where they are the first,
    as in most texts. odd: whether the text matches ODD."""
    own = F.coalesce(text, F.lit(""))
    plain = F.when(odd, F.regexp_replace(F.lower(own), NOT_PLAIN, " ")).otherwise(F.lower(own))
    return plain, F.when((odd & own.rlike(COMPOSED)) | own.rlike(SPECIAL), F.array_join(tokens(text), " "))


def nfc(text: Column) -> Column:
    """Unicode's composed form, by the Unicode library that Spark ships for its collations; only texts that may change
    go through it."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(COMPOSED), composed).otherwise(text)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("long")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITE, " "))


class Normal:
    """A text's normal form; starts and ends give each of its characters the range of the source it came from.

    It is made by clusters, of a character and the marks after it: each is folded or composed on its own.
    """

    def __init__(self, source: str):
        out, self.starts, self.ends, space, at = [], [], [], None, 0
        while at < len(source):
            end = at + 1
            while end < len(source) and unicodedata.category(source[end])[0] == "M":
                end += 1
            cluster = source[at:end]
            if is_white(cluster[0]):
                if out:
                    space = (space[0] if space else at, end)
            else:
                if space:
                    self._add(out, " ", *space)
                    space = None
                self._add(out, unicodedata.normalize("NFC", FOLDED.get(cluster, cluster)), at, end)
            at = end
        self.text = "".join(out)

    def _add(self, out: list[str], what: str, start: int, end: int) -> None:
        out.append(what)
        self.starts += [start] * len(what)
        self.ends += [end] * len(what)

    def find(self, needle: str) -> Iterator[tuple[int, int]]:
        """Source ranges of all places, those that overlap too."""
        at = self.text.find(needle) if needle else -1
        while at >= 0:
            yield self.starts[at], self.ends[at + len(needle) - 1]
            at = self.text.find(needle, at + 1)


FOLDED = {c: to for to, chars in SAME.items() for c in chars} | {ELLIPSIS: "..."}


def is_white(c: str) -> bool:
    return c.isspace() and not "\x1c" <= c <= "\x1f" or c == "\ufeff"


#: Vowels and ends of Korean syllables, which would join the letter before; a cluster is one of them alone.
JOINING = r"(?=[\x{1160}-\x{11FF}\x{D7B0}-\x{D7FB}])"
#: A code point that no text holds.
APART = "\uffff"


def normalize_for_match(text: Column) -> Column:
    """What quotes are compared by, the text of `Normal`: one space per run of white space, plain quotes and dashes,
    composed, case kept. Characters with marks are folded by clusters, in texts that may hold any."""
    found = "".join(SAME.values()) + " "
    by = "".join(k * len(v) for k, v in SAME.items()) + " "
    plain = collapse(F.replace(F.translate(text, found, by), F.lit(ELLIPSIS), F.lit("...")))
    marked = text
    for to, chars in (SAME | {"...": ELLIPSIS}).items():
        marked = F.regexp_replace(marked, f"[{chars}](?!\\p{{M}})", to)
    marked = F.replace(nfc(F.regexp_replace(marked, JOINING, APART)), F.lit(APART), F.lit(""))
    marked = F.trim(F.regexp_replace(marked, r"(?U)(?:[\s\x{FEFF}]\p{M}*)+", " "))
    return F.when(text.rlike(COMPOSED), marked).otherwise(plain)


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))


# A trailing bracket that holds claim numbers or chunk ids only, and how levels are named.
MARKERS = r"(?i)(?:\s*\[(?:(?:claims?|citazion[ei]|cita|fonte|source|sources)\s+)?(?:\d+(?:,\s*\d+)*|[0-9a-f]{16}(?:,\s*[0-9a-f]{16})*)\]\s*)+$"
LEVEL_IN_TITLE = r"\(Level (A{1,3})\)"
LEVEL_NAMED = r"(?<![A-Za-z0-9_])(?:(?:Level|Livello)\s+(A{1,3})|(AAA?))(?![A-Za-z0-9_])"
SC_REF = r"(?:Success Criterion|SC)\s+(\d+\.\d+\.\d+)(?![A-Za-z0-9_])|^(\d+\.\d+\.\d+)(?=\s)"


def strip_markers(sentence: Column) -> Column:
    return F.regexp_replace(sentence, MARKERS, "")


def level_rank(sentence: Column) -> Column:
    """0, 1, 2 for the lowest of A, AA, AAA that the sentence names; null if none."""
    named = F.transform(F.regexp_extract_all(sentence, F.lit(LEVEL_NAMED), F.lit(0)), lambda x: F.length(F.regexp_extract(x, "(A+)$", 1)) - 1)
    return F.array_min(named)


def level_of(title: Column, text: Column) -> Column:
    """The level in the title, else the only one in the text."""
    inside = F.array_distinct(F.regexp_extract_all(text, F.lit(LEVEL_IN_TITLE), F.lit(1)))
    titled = F.regexp_extract(title, LEVEL_IN_TITLE, 1)
    return F.when(F.coalesce(titled, F.lit("")) != "", titled).when(F.size(inside) == 1, inside[0])


def names_level(sentence: Column, sc_ref: Column, level: Column) -> Column:
    edge, end = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    a = sentence.rlike(edge + r"(?:Level|Livello)\s+A" + end)
    return F.when(level == "A", a).when(level == "AA", sentence.rlike(edge + "AA" + end)).otherwise(sentence.rlike(edge + "AAA" + end)) | F.coalesce(F.contains(sentence, sc_ref), F.lit(False))


def sc_ref_of(path: Column) -> Column:
    """The reference in the deepest heading that has one."""
    found = F.transform(F.reverse(path), lambda h: F.coalesce(F.nullif(F.regexp_extract(h, SC_REF, 1), F.lit("")), F.nullif(F.regexp_extract(h, SC_REF, 2), F.lit(""))))
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))


def source_title(title: Column, path: Column) -> Column:
    """What a source is called in a prompt: its document and the headings above it."""
    return F.array_join(F.concat(F.array(title), path), " > ")


def document_text(path: Column, text: Column) -> Column:
    """What is indexed: the headings and the text below them."""
    return F.concat(F.array_join(path, " > "), F.lit("\n"), text)


def chunk_key(doc_id: Column, path: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", doc_id, F.array_join(path, " > "), text), 256), 1, 16)


def escape_attribute(value: Column) -> Column:
    for found, by in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(found), F.lit(by))
    return value


def source_block(chunk_id: Column, title: Column, text: Column) -> Column:
    """One source of a prompt."""
    titled = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(' title="'), escape_attribute(title), F.lit('"'))).otherwise(F.lit(""))
    return F.concat(F.lit('<source id="'), chunk_id, F.lit('"'), titled, F.lit(">\n"), text, F.lit("\n</source>"))


def evidence(title: Column, path: Column, text: Column) -> Column:
    """What a judge reads."""
    return F.concat_ws("\n", title, F.array_join(path, " > "), F.lit(""), text)


def preview(text: Column) -> Column:
    """Blocks that aren't headings, in one line."""
    return F.array_join(F.filter(F.split(text, "\n\n"), lambda b: ~F.startswith(b, F.lit("#"))), " ")


def heading_label(path: Column, title: Column) -> Column:
    return F.coalesce(F.try_element_at(path, F.lit(-1)), title)
