"""Problem 5: one form for text that looks the same."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.runtime import small, staged

#: Latin letters that letters of other scripts are drawn like, likeliest first (fixed values).
ALIKE = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "ё": "ë", "һ": "h", "і": "i", "ї": "ï", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "и": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "в": "b", "н": "h",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ё": "Ë", "Н": "H", "І": "I", "Ї": "Ï", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ғ": "F", "З": "3",
    # Greek
    "α": "a", "β": "b", "γ": "yv", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "uvy", "χ": "x", "ω": "w", "ς": "c", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "ա": "w", "Տ": "S", "Լ": "L", "Օ": "O",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮒ": "h", "Ꮓ": "Z", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏼ": "B",
    # Coptic
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "ⲩ": "y", "Ⲭ": "X", "ⲭ": "x",
    # Latin drawn as other Latin
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "L", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
}
#: Scripts whose letters are drawn like one another's.
MINGLED = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "COPTIC", "CHEROKEE")
#: Characters that are left as they are though they have a compatibility form: legal and typographic signs.
OWN_RIGHT = "™℠…‥´¨¯¸·½¼¾²³¹ªºµ№℅℀℁‑"
#: Kinds of compatibility form that are another width or style of the same character.
STYLES = ("<font>", "<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>", "<vertical>")

#: Letters of the shortest word of which one foreign letter may stand for any.
LEAST_LETTERS = 5

#: What a text must hold to be looked at more closely: all but ASCII, typographic quotes and dashes, signs, and letters with accents in one character.
SUSPECT = r"[^\n\t\r -~¡-¬®-İĴ-ľŁ-ňŊ-ž‐-―‘-‟†-•…‰‹›€™]"

#: Of ASCII, what isn't drawn.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"

_mark = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]")
_word = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


# What has been looked up of single characters. Plain dictionaries, since functions under a decorator
# from the standard library would not travel to the executors by value.
_SCRIPTS: dict[str, str] = {}
_PLAIN: dict[str, str | None] = {}


def script(ch: str) -> str:
    """The script of a letter by its name; empty for what is no letter."""
    if ch not in _SCRIPTS:
        _SCRIPTS[ch] = unicodedata.name(ch, "").split(" ")[0] if unicodedata.category(ch)[0] == "L" else ""
    return _SCRIPTS[ch]


def plain(ch: str) -> str | None:
    """``stand_in``, remembered."""
    if ch not in _PLAIN:
        _PLAIN[ch] = stand_in(ch)
    return _PLAIN[ch]


def stand_in(ch: str) -> str | None:
    """What stands for ``ch`` wherever it is: None if it stays, an empty string if it isn't drawn. Letters of other scripts depend on their word and stay here."""
    code = ord(ch)
    kind = unicodedata.category(ch)
    if ch in "\n\t " or 32 < code < 127:
        return None
    if ch in "\u2028\u2029\u0085\x0b\x0c\r":
        return None
    if kind == "Zs":
        return " "
    if kind in ("Cf", "Cc") or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or ch in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0\u2800\u180b\u180c\u180d\u180e":
        return None if kind == "Cf" and 0x600 <= code <= 0x8E2 else " " if ch == "\u2800" else ""
    if ch in OWN_RIGHT:
        return None
    form = unicodedata.decomposition(ch)
    if form.startswith("<"):
        if not form.startswith(STYLES):
            return None
        to = unicodedata.normalize("NFKC", ch)
        return to if to != ch else None
    to = unicodedata.normalize("NFC", ch)
    return to if to != ch else None


def joins_in_place(text: str, i: int) -> bool:
    """Whether a joiner or variation selector at ``i`` shapes what stands around it: inside Arabic, Syriac or Indic words, or within an emoji."""
    a, b = text[i - 1 : i], text[i + 1 : i + 2]
    if not a:
        return False
    if ord(a) >= 0x2190 and unicodedata.category(a) in ("So", "Sk", "Mn"):
        return text[i] != "\u200d" or bool(b and ord(b) >= 0x2190)
    return text[i] in "\u200c\u200d" and bool(b) and all(0x590 <= ord(c) <= 0x1FFF and unicodedata.category(c)[0] in "LM" for c in (a, b))


def settled(text: str) -> tuple[str, int]:
    """``text`` with everything but letters of other scripts brought to one form, and the number of characters that changed.

    Compatibility widths and styles, spaces, characters that aren't drawn, and separate accents; a
    carriage return before a line feed goes too, but isn't counted.
    """
    out, n = [], 0
    for i, ch in enumerate(text):
        to = plain(ch)
        if to is None or (ch in "\u200c\u200d\ufe0e\ufe0f" and joins_in_place(text, i)):
            out.append(ch)
        else:
            out.append(to)
            n += 1
    text = "".join(out).replace("\r\n", "\n")
    if _mark.search(text):
        n += sum(1 for m in _mark.finditer(text) if m.start() and script(text[m.start() - 1]) in ("LATIN", "GREEK", "CYRILLIC"))
        text = unicodedata.normalize("NFC", text)
    return text, n


def mixed(word: str) -> bool:
    """Whether a word has letters of two scripts that are drawn alike."""
    return not word.isascii() and len({script(c) for c in word} & set(MINGLED)) > 1


def mixed_words(text: str) -> list[str]:
    return [] if text.isascii() else [w for w in _word.findall(text) if mixed(w)]


def home(word: str) -> str:
    """The script that a mixed word is meant in: Latin if its other letters all have a Latin look-alike, else the script of most letters."""
    if all(script(c) == "LATIN" or c in ALIKE or not script(c) for c in word):
        return "LATIN"
    return Counter(script(c) for c in word if script(c)).most_common(1)[0][0]


_BACK: dict[str, dict[str, str]] = {}
for _other, _latin in ALIKE.items():
    for _c in _latin[:1]:
        _BACK.setdefault(script(_other), {}).setdefault(_c, _other)


def by_table(word: str) -> str:
    """``word`` with the letters of other scripts replaced by the likeliest look-alike of its home script."""
    to = home(word)
    if to == "LATIN":
        return "".join(ALIKE[c][0] if c in ALIKE and script(c) != "LATIN" else c for c in word)
    return "".join(_BACK.get(to, {}).get(c, c) if script(c) == "LATIN" else c for c in word)


#: Letters that one look-alike may stand for are one in a key, so that a word and all its spellings meet.
_ONE = str.maketrans({"v": "u", "y": "u"})


def foreign(ch: str) -> bool:
    """Whether a letter is of a script drawn like Latin, but itself like no Latin letter that the table knows."""
    return ch not in ALIKE and script(ch) in MINGLED and script(ch) != "LATIN"


def key(word: str) -> str:
    """What a word shares with its spellings: its form by the table; with one foreign letter in a word meant as Latin, that form without the letter."""
    low = by_table(word).lower()
    odd = [i for i, c in enumerate(low) if foreign(c)]
    if len(odd) == 1 and len(word) >= LEAST_LETTERS and home(word) == "LATIN":
        low = "*" + low[: odd[0]] + low[odd[0] + 1 :]
    return low.translate(_ONE)


def keys(word: str) -> set[str]:
    """The keys that a word of the vocabulary may be looked for under: its own, and those without one letter."""
    low = word.lower().translate(_ONE)
    return {low} | ({"*" + low[:i] + low[i + 1 :] for i in range(len(low))} if len(low) >= LEAST_LETTERS else set())


class Trie:
    """Words as nested dictionaries; ``None`` holds the count where a word ends."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[None] = node.get(None, 0) + count

    def spell(self, word: str, most: float = 0.0, paid: Callable[[str], bool] | None = None) -> str | None:
        """The spelling reached at the least cost up to ``most`` by a weighted edit automaton, the commonest of equal ones; None if there is none.

        Look-alikes and characters that aren't drawn cost nothing, any other edit 1. With ``paid``
        only letters it holds of may be replaced or dropped, and none put in. A state is a position in
        the word and a node of the trie, visited again only at less cost. With ``most`` 0 only
        look-alikes are followed.
        """
        best: tuple[float, int, str] | None = None
        seen: dict[tuple[int, str], float] = {}
        stack = [(0.0, 0, "", self.root)]
        while stack:
            cost, i, done, node = stack.pop()
            if cost >= seen.get((i, done), most + 1):
                continue
            seen[i, done] = cost
            if i == len(word):
                if None in node:
                    found = (cost, -node[None], done)
                    best = found if best is None or found < best else best
            else:
                c = word[i]
                near = {c, *ALIKE.get(c, "")}
                stack.extend((cost, i + 1, done + d, node[d]) for d in near if d in node)
                edit = cost < most and (paid is None or paid(c))
                if plain(c) == "":
                    stack.append((cost, i + 1, done, node))
                elif edit:
                    stack.append((cost + 1, i + 1, done, node))
                if edit:
                    stack.extend((cost + 1, i + 1, done + d, child) for d, child in node.items() if d is not None and d not in near)
            if cost < most and paid is None:
                stack.extend((cost + 1, i, done + d, child) for d, child in node.items() if d is not None)
        return best[2] if best else None


def spelled(word: str, trie: Trie) -> str | None:
    """A spelling of ``word`` in the trie: as it stands, else in lower case and cased like the word."""
    most = float(any(map(foreign, word)))  # one such letter may stand for any, since the table knows no likeness of it
    found = trie.spell(word, most, foreign)
    if found is None:
        low = trie.spell(word.lower(), most, foreign)
        if low is not None:
            shape = by_table(word)
            found = low.upper() if shape.isupper() and len(shape) > 1 else low[:1].upper() + low[1:] if shape[:1].isupper() else low
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suspect texts to their settled form, with the mixed words left in it."""
    for b in batches:
        done = [settled(t) for t in b.column(2).to_pylist()]
        words = [sorted(set(mixed_words(t))) for t, _ in done]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32()), pa.array(words, pa.list_(pa.string()))],
            ["tbl", "record_id", "text", "n", "words"],
        )


def _vocabulary(starred: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the words a batch holds that are plain Latin, in any case, under each key they may be looked for by; without one letter only if ``starred``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter = Counter()
            for t in b.column(0).to_pylist():
                c.update(_word.findall(t))
            rows = [(w, n) for w, n in c.items() if w.isascii() or (not mixed(w) and script(w[0]) == "LATIN" and plain(w[0]) is None)]
            found = [(k, w, n) for w, n in rows for k in ({key(w)} | keys(w) if starred else {key(w)})]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["key", "word", "n"])

    return count


def spellings(words: DataFrame, texts: DataFrame, shards: int | None = None) -> DataFrame:
    """``(word, spelling)`` of each distinct mixed word of ``words(word)``, by tries over the vocabulary of ``texts(text)``.

    Words and their spellings share a key (:func:`key`, :func:`keys`), so each key's part of the vocabulary is a small trie of
    its own, and any number of tasks share the work. Only vocabulary whose key some mixed word has is
    shuffled. A word no trie holds is spelled by the table.
    """
    to_key = F.pandas_udf(lambda s: s.map(key), "string")
    asked = staged(words.distinct().withColumn("key", to_key("word")))
    wanted = asked.select("key").distinct()
    count = texts.mapInArrow(_vocabulary(not asked.filter("key LIKE '*%'").isEmpty()), "key string, word string, n long")
    known = count.join(small(wanted), "key", "left_semi").groupBy("key", "word").agg(F.sum("n").alias("n"))
    shards = shards or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards * 4)).cast("int")

    def look_up(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        trie = Trie()
        for w, n in dict(zip(known["word"], known["n"])).items():
            trie.add(w, n)
        return pd.DataFrame({"word": asked["word"], "spelling": [spelled(w, trie) or by_table(w) for w in asked["word"]]})

    a, k = asked.withColumn("shard", shard), known.withColumn("shard", shard)
    return a.groupBy("shard").cogroup(k.groupBy("shard")).applyInPandas(look_up, "word string, spelling string")


def consistent(records: DataFrame) -> DataFrame:
    """``records(tbl, record_id, text)`` with ``text`` in one form and ``n_changed``, the characters and words that stood in for others.

    Widths and styles of a character, ligatures, spaces, characters that aren't drawn and separate
    accents are settled one by one; a word of letters of several scripts takes the commonest spelling
    in the collection's vocabulary that looks the same, else that of the table. Line ends become
    line feeds without counting. Characters used in their own right stay: quotes and dashes, currency
    and legal signs, accented letters, words and symbols wholly in another script, joiners that shape
    the script or emoji around them.

    Null texts stay null; empty ones empty; repeated rows come out once. Only texts that hold a
    suspect character go through Python for it; the rest stay in the JVM.
    """
    rows = records.select("tbl", "record_id", "text")
    # Most texts have as many bytes as characters, so ASCII only, and need no look at the long class.
    suspect = ((F.octet_length("text") != F.length("text")) & F.col("text").rlike(SUSPECT)) | F.col("text").rlike(CONTROL)
    clean = rows.filter(F.coalesce(~suspect, F.lit(True))).distinct().withColumn("n_changed", F.lit(0)).withColumn("text", F.regexp_replace("text", "\r\n", "\n"))
    scanned = staged(rows.filter(suspect).distinct().mapInArrow(_scan, "tbl string, record_id string, text string, n int, words array<string>"))
    simple = scanned.filter(F.size("words") == 0).select("tbl", "record_id", "text", F.col("n").alias("n_changed"))
    some = scanned.filter(F.size("words") > 0)
    found = spellings(some.select(F.explode("words").alias("word")), rows.filter("text IS NOT NULL").select("text"))
    # A text stands for all records that hold it, and its hash for the text.
    each = some.select(F.xxhash64("text").alias("h"), F.explode("words").alias("word")).distinct().join(found, "word")
    maps = each.groupBy("h").agg(F.map_from_entries(F.collect_set(F.struct("word", "spelling"))).alias("to"))

    def respell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, n = [], []
            for t, m, to in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                to = dict(to)
                done, k = _word.subn(lambda x, to=to: to.get(x.group(), x.group()), t)
                out.append(done)
                n.append(m + len(to))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(n, pa.int32())], ["tbl", "record_id", "text", "n_changed"])

    joined = some.withColumn("h", F.xxhash64("text")).join(maps, "h").select("tbl", "record_id", "text", "n", "to")
    hard = joined.mapInArrow(respell, "tbl string, record_id string, text string, n_changed int")
    return clean.unionByName(simple).unionByName(hard)


def texts_of(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Both tables' texts as ``(tbl, record_id, text)``."""
    a = chunks.select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("record_id"), "text")
    return a.unionByName(questions.select(F.lit("eval_narrative").alias("tbl"), F.col("qid").alias("record_id"), F.col("question").alias("text")))
