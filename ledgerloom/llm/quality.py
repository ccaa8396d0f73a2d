"""Quality rules by line-first cleaning.

Every line is judged (navigation, boilerplate, punctuation), failing lines are removed, and a document is
rejected when the base rules fail or when too much of its text went with the removed lines. A line without closing punctuation
fails if it has fewer than eight words, unless it stands alone above a line of prose, as headings do; so do several short lines in
a row, which are lists of links.

Edge cases: a null text has no words and one empty line, counts as zero everywhere and is rejected (fewer than 50
words); an empty text likewise. Whole texts are read whatever their length. Repeated rows give repeated results, an
empty table gives an empty table, and columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.common import map_texts

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document that loses more than this share of its words' characters with failing lines is rejected.
MAX_LOST_PERCENT = 60
SYMBOLS = "#*$%&|<>"

_END = (".", "!", "?", ":", ";", ",", '"', "'", ")", "]", "…", "»", "”", "’", "。", "！", "？")
#: Phrases that mark a line as a site's own furniture.
BOILERPLATE = (
    "accept cookies", "add to cart", "advertisement", "all rights reserved", "alle rechte vorbehalten", "click here", "cookie policy",
    "cookie settings", "create an account", "datenschutzerklärung", "enable javascript", "follow us on", "forgot your password",
    "javascript is disabled", "leave a comment", "leave a reply", "licensed under the", "lorem ipsum", "mentions légales",
    "newsletter", "política de privacidad", "powered by", "privacy policy", "read more", "share on", "share this", "sign in", "sign up",
    "subscribe to our", "terms and conditions", "terms of service", "terms of use", "todos los derechos reservados", "tous droits réservés",
)
#: Words of menus and page controls; a short line of nothing else is navigation.
NAVIGATION = frozenset(
    """about account archive archives back blog cart categories checkout close comments contact content download email faq feedback first forum
    forums gallery help home imprint index jobs last links login logout main menu more navigation next older newer news page pages prev
    previous print profile register reply reset rss save search settings share shop sidebar sitemap skip subscribe support tags top tweet
    accueil recherche suivant précédent connexion startseite suche impressum kontakt anmelden weiter zurück inicio buscar siguiente
    anterior contacto log sign""".split()
)
#: Words that may stand between those.
_BETWEEN = frozenset("a all and in of on our out the this to up us your à de du et la le zum zur und al el y".split())
#: Boilerplate is looked for in lines of up to so many characters; in longer ones it takes three different phrases.
SHORT_CHARS = 200
#: An unpunctuated line of fewer words is no sentence.
FEW_WORDS = 8
#: A line of at least so many words in which most end in exclamation marks is shouting.
SHOUT_WORDS = 5

_SEPARATED = re.compile(r"\s*\|\s*|\s[>»•·/]\s|\s*[»•·]\s*")
_COPYRIGHT = re.compile(r"(©|\(c\)|copyright)\s*(\(c\)|©)?\s*(19|20)\d\d", re.IGNORECASE)
_DATED = re.compile(r"(posted|published|updated|last modified|veröffentlicht|publié|publicado)\b.{0,60}\d", re.IGNORECASE)
_PAGING = re.compile(r"(page|seite|página)\s+\d+(\s*(/|of|von|de|sur)\s*\d+)?|[«‹<]*\s*(\d+\s+){2,}\S*\s*[»›>]*|\d+\s+(comments?|replies|views|shares|likes)", re.IGNORECASE)
_ADDRESS = re.compile(r"(https?://|www\.)\S+|\S+@\S+\.\w+|\S+\.(com|org|net|html?|php)(/\S*)?", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
#: So many successive lines of few words without closing punctuation are a list of links, even above prose.
LIST_LINES = 5
LIST_WORDS = 3
LIST_CHARS = 40

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("n_failed_lines", T.LongType()),
        T.StructField("lost_chars", T.LongType()),
    ]
)
CLEANED = T.StructType([*FIELDS.fields, T.StructField("cleaned_text", T.StringType())])


def navigation(line: str) -> bool:
    """Whether a line is a menu, a trail of links, a page control, or nothing but an address."""
    if len(line) > 400:
        return False
    if any(mark in line for mark in "|>»•·/"):
        items = [x for x in _SEPARATED.split(line) if x.strip()]
        words = sum(len(x.split()) for x in items)
        if len(items) > 2 and words <= 3 * len(items) or len(items) == 2 and words <= 4 and not line.endswith(_END):
            return True
    if len(line) > 80:
        return False
    words = [w.lower() for w in _WORD.findall(line)]
    if words and len(words) <= 5 and any(w in NAVIGATION for w in words) and all(w in NAVIGATION or w in _BETWEEN for w in words):
        return True
    bare = line.rstrip(".:")
    return bool(_PAGING.fullmatch(bare) or _ADDRESS.fullmatch(bare))


def boilerplate(line: str) -> bool:
    """Whether a line is a notice of the site: rights, licenses, cookies, scripts, subscriptions, bylines."""
    low = line.lower()
    if len(line) > SHORT_CHARS:
        return sum(x in low for x in BOILERPLATE) >= 3
    return any(x in low for x in BOILERPLATE) or bool(_COPYRIGHT.search(line)) or len(line) <= 80 and bool(_DATED.match(line))


def unpunctuated(line: str) -> bool:
    """Whether a line is too short for a sentence and doesn't close like one."""
    return not line.endswith(_END) and len(line.split()) < FEW_WORDS


def overmarked(line: str) -> bool:
    """Whether symbols, or exclamation marks, decorate the words, or no letters are left."""
    words = line.split()
    marks = sum(map(line.count, SYMBOLS))
    if marks >= 3 and 3 * marks > len(words):
        return True
    if line.count("!") >= SHOUT_WORDS and 2 * sum(w.endswith("!") for w in words) > len(words) >= SHOUT_WORDS:
        return True
    return not any(map(str.isalpha, line))


def line_fails(line: str, heads: bool = False) -> bool:
    """Whether one non-blank line is navigation, boilerplate or no sentence; ``heads``: a line of prose follows it."""
    stripped = line.strip()
    return navigation(stripped) or boilerplate(stripped) or overmarked(stripped) or not heads and unpunctuated(stripped)


def headings(lines: Sequence[str]) -> set[int]:
    """Places of unpunctuated lines that stand alone above a line of prose; blank lines don't count."""
    found, last = set(), None  # the unpunctuated line that waits for its prose
    for i, line in enumerate(lines):
        stripped = line.strip()
        if not stripped:
            continue
        if unpunctuated(stripped):
            last = i if last is None else -1
        else:
            if last is not None and last >= 0 and len(stripped.split()) >= FEW_WORDS:
                found.add(last)
            last = None
    return found


def listed(lines: Sequence[str]) -> set[int]:
    """Places of lines in runs of at least LIST_LINES short lines without closing punctuation; blank lines don't end a run."""
    found, run = set(), []
    for i, line in enumerate(lines):
        stripped = line.strip()
        if not stripped:
            continue
        if len(stripped) <= LIST_CHARS and not stripped.endswith(_END) and len(stripped.split()) <= LIST_WORDS:
            run.append(i)
            continue
        if len(run) >= LIST_LINES:
            found.update(run)
        run = []
    if len(run) >= LIST_LINES:
        found.update(run)
    return found


def repeated_words(words: Sequence) -> int:
    """Words that lie in a 3-word window found twice or more in the text, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    first: dict = {}
    repeated = bytearray(n)
    for i, window in enumerate(windows):
        seen = first.setdefault(window, i)
        if seen != i:
            repeated[i] = repeated[i + 1] = repeated[i + 2] = 1
            repeated[seen] = repeated[seen + 1] = repeated[seen + 2] = 1
    return sum(repeated)


def judge(text: str | None) -> tuple:
    """The values of ``CLEANED`` for one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    repeats = repeated_words(words)
    base_failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n_words
    lines, seen, dups, failed, lost, clean = text.split("\n"), set(), 0, 0, 0, []
    short, above = listed(lines), headings(lines)
    for i, line in enumerate(lines):
        if line.strip(" \t\x0b\x0c\r"):
            if line in seen:
                dups += 1
            else:
                seen.add(line)
            if i in short or line_fails(line, i in above):
                failed += 1
                lost += len(line) - sum(map(line.count, " \t\x0b\x0c\r"))
                continue
        clean.append(line)
    kept = not base_failed and 100 * lost <= MAX_LOST_PERCENT * word_chars
    return (n_words, word_chars, sum(map(text.count, SYMBOLS)), dups, repeats, base_failed, kept, len(lines), failed, lost, "\n".join(clean))


def quality_rules(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), cleaned: bool = False) -> DataFrame:
    """Counts and verdict for each row; with ``cleaned`` also the text without its failing lines."""
    fields = CLEANED if cleaned else FIELDS
    names = fields.names

    def make():
        def work(texts):
            made = [judge(x) for x in texts]
            return {name: [row[i] for row in made] for i, name in enumerate(names)}

        return work

    return map_texts(df, text, make, fields, keep)
