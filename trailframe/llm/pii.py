"""PII replacement by keyed, type-consistent surrogates.

Entities (emails, phones, IPv4 addresses, card and identity numbers, IBANs, secrets, titled person names) are found by
pattern. A surrogate is a keyed permutation of the entity's letters and digits within their classes (a Feistel cipher
over each class, with the shape as tweak), so the type, script, case, length and punctuation stay, equal entities get
equal surrogates everywhere and different ones never meet. Given names get names of the same gender and script (common
ones, and when those are taken, syllables with an ending of the gender), surnames get syllables of the script. Both are
replaced apart, and a name found with a title is replaced everywhere in the text, so "Dr. Ada Byron", "Ada Byron", "Ada"
and "Byron" agree (so is a common word that serves as a name there; a name that is both counts as a surname unless it
stands in a full name). Names that have no title anywhere in their text are not found. A given name has one gender in the
corpus: that of most of its titles that tell one.

Collision check: a surrogate must differ from every entity of its kind in the corpus and from every other surrogate of
the kind; the loser (the larger value) tries the next attempt number until none is left. Only those exceptions
and the genders of given names are looked up when texts are rewritten: from a broadcast map while they are few, else
joined to their documents by shuffle.

Secrets are access keys and values of at least 8 characters assigned to a keyword; values of token and key keywords, which
prose also has, need a digit, those of password and secret keywords do not.

Null text stays null, empty text empty; texts are scanned whole. Repeated rows give repeated results. All columns pass
through; only text changes.
"""

from __future__ import annotations

import hmac
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, checkpointed, map_arrow

MOST_ATTEMPTS = 32
#: What may stand between the parts of a phone number in damaged texts.
_GAP = r"[\s|!#*$%&]{0,6}"
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω][\wÀ-ÿ'’-]+"
#: Titles by gender (fixed values); None: the title does not tell.
TITLES = {
    "m": ("Mr", "Sir", "Herr", "Señor", "Monsieur", "Г-н", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Madame", "Mme", "Г-жа", "Госпожа", "Κυρία"),
    "n": ("Dr", "Prof"),
}
#: Given names by script and gender, and syllables of surnames by script (fixed values).
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Nils Otto Paul Robin Simon Thomas Victor".split(),
    ("latin", "f"): "Alma Berta Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nora Olga Petra Rosa Sarah Tessa Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Степан Юрий".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Жанна Ирина Лариса Мария Нина Ольга Раиса София Тамара Юлия".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Ηλίας Κώστας Λεωνίδας Μιχάλης Νίκος Πέτρος Σταύρος".split(),
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Κατερίνα Μαρία Νίκη Σοφία".split(),
}
SYLLABLES = {
    "latin": "bar ben col dan der fal gor hal kel lan mar nor pel ros sen tor val wen".split(),
    "cyrillic": "бар вел гор дан зор кал лен мар нор пет рос сав тор фед хол".split(),
    "greek": "βαλ γερ δαν θεο καλ λαμ μαν νικ παπ ροδ σαρ τζα φιλ χαρ".split(),
}
#: Endings of composed given names by script and gender; no ending of one gender ends like one of the other (fixed values).
ENDINGS = {
    ("latin", "m"): "bert fried hard mund rich ton us win".split(),
    ("latin", "f"): "a ella elle ia ina ine lotte trud".split(),
    ("cyrillic", "m"): "ий ил мир ор рат слав фей".split(),
    ("cyrillic", "f"): "ана ева ела ида ина ия уша".split(),
    ("greek", "m"): "άκης έας ίας ίδης ιος ος ωνας".split(),
    ("greek", "f"): "άνα έλη ίνα ία ούλα ω ώνη".split(),
}
_TITLE = "|".join(t for v in TITLES.values() for t in v)
#: Each pattern begins with a fixed character or class, which the re module finds fast; see Finder for what may precede.
DOMAIN = re.compile(r"@[\w-]+(?:\.[\w-]+)+")
ACCESS_KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Z])")
KEYWORD = re.compile(r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_/+\-]{8,})")
#: Keywords whose value is a secret even without a digit.
SAYS_SECRET = ("password", "passwd", "pwd", "secret")
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "key")
IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: A stretch that may hold numbers, and the numbers in it by falling priority.
NUMBERS = re.compile(r"[+(0-9][0-9\s().+|!#*$%&-]{5,}[0-9]")
NUMBER = re.compile(
    r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    rf"|(?P<phone>(?<![\w+])\+\d{{1,3}}{_GAP}(?:\(\d{{2,4}}\)|\d{{2,4}}){_GAP}[ .-]?\d{{3,4}}{_GAP}[ .-]?\d{{3,4}}(?!\d)|(?<![\w+(])\(\d{{3}}\){_GAP}\d{{3}}[ .-]\d{{4}}(?!\d)|(?<![\d.-])\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?![\d-]))"
    r"|(?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?!\d|\.\d))"
)
PERSON = re.compile(rf"\b(?P<title>{_TITLE})\.? (?P<first>{_CAP})(?: (?P<last>{_CAP}))?")
DIGIT = re.compile(r"[0-9]")
_GENDER = {t: g for g, v in TITLES.items() for t in v}


def script(word: str) -> str:
    return "cyrillic" if re.search("[А-яЁё]", word) else "greek" if re.search("[Α-ωά-ώ]", word) else "latin"


class Finder:
    """Units (kind, value, start, end) of a text: each is replaced on its own."""

    @staticmethod
    def people(text: str) -> list[tuple[str, tuple[int, int] | None, tuple[int, int] | None]]:
        """(title, span of the given name, span of the surname) of the titled names.

        One name after a title is a surname, unless the text has it as a given name only.
        """
        if not any(t in text for t in _GENDER):
            return []
        found = list(PERSON.finditer(text))
        given, surnames = {m["first"] for m in found if m["last"]}, {m["last"] for m in found if m["last"]}
        lone = lambda m: (m["title"], m.span("first"), None) if m["first"] in given - surnames else (m["title"], None, m.span("first"))
        return [(m["title"], m.span("first"), m.span("last")) if m["last"] else lone(m) for m in found]

    @staticmethod
    def genders(text: str) -> list[tuple[str, str, str]]:
        """(kind, value, gender) of the given names whose title tells the gender."""
        named = [(text[slice(*first)], _GENDER[title]) for title, first, _ in Finder.people(text) if first]
        return [(f"given-{script(n)}", n, g) for n, g in named if g != "n"]

    @staticmethod
    def units(text: str) -> list[tuple[str, str, int, int]]:
        out: list[tuple[str, str, int, int]] = []

        def add(kind: str, start: int, end: int) -> None:
            if not any(a < end and start < b for _, _, a, b in out):
                out.append((kind, text[start:end], start, end))

        if "@" in text:
            for m in DOMAIN.finditer(text):
                start = m.start()
                while start and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
                    start -= 1
                while text[start] == ".":
                    start += 1
                if start < m.start():
                    add("email", start, m.end())
        digits = DIGIT.search(text) is not None
        if digits and "AKIA" in text:
            for m in ACCESS_KEY.finditer(text):
                add("secret", *m.span())
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            for m in KEYWORD.finditer(text):
                if DIGIT.search(m[1]) or m[0].lower().startswith(SAYS_SECRET):
                    add("secret", *m.span(1))
        if digits:
            for m in IBAN.finditer(text):
                if not text[m.start() - 1 : m.start()].isalnum():
                    add("iban", *m.span())
            for blob in NUMBERS.finditer(text):
                for m in NUMBER.finditer(text, *blob.span()):
                    add(m.lastgroup, *m.span())
        full, given, surnames = {}, {}, {}
        for _, first, last in Finder.people(text):
            names = [text[slice(*x)] if x else None for x in (first, last)]
            if first:
                add(f"given-{script(names[0])}", *first)
                given[names[0]] = None
            if last:
                add(f"surname-{script(names[1])}", *last)
                surnames[names[1]] = None
            if first and last:
                full[tuple(names)] = None
        for first, last in full:
            for m in re.finditer(rf"\b({re.escape(first)})\s+({re.escape(last)})\b", text):
                add(f"given-{script(first)}", *m.span(1))
                add(f"surname-{script(last)}", *m.span(2))
        for kind, names in (("surname", surnames), ("given", given)):
            for name in names:
                for m in re.finditer(rf"\b{re.escape(name)}\b", text):
                    add(f"{kind}-{script(name)}", *m.span())
        return sorted(out, key=lambda u: u[2])


class Surrogates:
    """Keyed replacement of units."""

    def __init__(self, key: bytes):
        self.key, self.memo = key, {}

    def draw(self, *parts) -> int:
        return int.from_bytes(hmac.new(self.key, "\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), sha256).digest(), "big")

    def permute(self, digits: list[int], radix: int, *tweak) -> list[int]:
        """A keyed permutation of the strings of this length over the radix (an alternating Feistel network)."""
        n = len(digits)
        if n == 0:
            return []
        if n == 1:
            return [(digits[0] + self.draw("one", radix, *tweak)) % radix]
        u = n // 2
        number = lambda ds: sum(d * radix**i for i, d in enumerate(ds))
        a, b, big, small = number(digits[:u]), number(digits[u:]), radix ** (n - u), radix**u
        for r in range(8):
            if r % 2:
                b = (b + self.draw(r, radix, n, a, *tweak)) % big
            else:
                a = (a + self.draw(r, radix, n, b, *tweak)) % small
        return [a // radix**i % radix for i in range(u)] + [b // radix**i % radix for i in range(n - u)]

    #: Character classes: first character and size; others stay as they are.
    CLASSES = (("0", 10), ("a", 26), ("A", 26), ("а", 32), ("А", 32), ("α", 25), ("Α", 17))

    def shaped(self, kind: str, value: str, attempt: int, hexadecimal: bool = False) -> str:
        """value with each class of characters permuted; earlier classes are tweaks of the later ones."""
        out, said = list(value), ""
        classes = [("hex", 16), *self.CLASSES[2:]] if hexadecimal else list(self.CLASSES)
        shape = "".join(next((f for f, s in self.CLASSES if ord(f) <= ord(c) < ord(f) + s), c) for c in value) if not hexadecimal else f"hex{len(value)}"
        for first, size in classes:
            member = (lambda c: c in "0123456789abcdef") if first == "hex" else (lambda c, f=ord(first), s=size: f <= ord(c) < f + s)
            at = [i for i, c in enumerate(value) if member(c)]
            if at:
                code = [int(value[i], 16) if first == "hex" else ord(value[i]) - ord(first) for i in at]
                for i, d in zip(at, self.permute(code, size, kind, shape, attempt, first, said), strict=True):
                    out[i] = f"{d:x}" if first == "hex" else chr(ord(first) + d)
                said += "".join(value[i] for i in at)
        return "".join(out)

    def surrogate(self, kind: str, value: str, attempt: int = 0, gender: str = "n") -> str:
        found = self.memo.get((kind, value, attempt, gender))
        if found is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            found = self.memo[kind, value, attempt, gender] = self.make(kind, value, attempt, gender)
        return found

    def make(self, kind: str, value: str, attempt: int, gender: str) -> str:
        if kind == "ip":
            return ".".join(map(str, self.permute([int(x) for x in value.split(".")], 256, kind, attempt)))
        if kind == "email":
            local, _, domain = value.partition("@")
            host, dot, top = domain.rpartition(".")
            return self.shaped(kind, f"{local}@{host}", attempt) + dot + top
        if kind == "card":
            return self.card(value, attempt)
        if kind == "phone" and value.startswith("+"):
            code = re.match(r"\+\d{1,3}(?=\D)|\+\d", value)[0]
            return code + self.shaped(kind + code, value[len(code) :], attempt)
        if kind == "iban":
            return value[:2] + self.shaped(kind + value[:2], value[2:], attempt)
        if kind == "secret":
            if value.startswith("AKIA"):
                return "AKIA" + self.shaped(kind, value[4:], attempt)
            return self.shaped(kind, value, attempt, hexadecimal=re.fullmatch(r"[0-9a-f]+", value) is not None)
        if kind.startswith("given-"):
            return self.given(kind, value, attempt, kind.split("-")[1], gender)
        if kind.startswith("surname-"):
            return self.name(kind, value, attempt, kind.split("-")[1])
        return self.shaped(kind, value, attempt)

    def given(self, kind: str, value: str, attempt: int, alphabet: str, gender: str) -> str:
        """A common given name of the gender at first, later syllables with an ending of the gender; "n" takes either gender."""
        genders, draw = gender if gender != "n" else "mf", self.draw(kind, value, attempt)
        if attempt == 0:
            names = [n for g in genders for n in GIVEN[alphabet, g]]
            return names[draw % len(names)]
        endings = [e for g in genders for e in ENDINGS[alphabet, g]]
        draw, ending = draw // len(endings), endings[draw % len(endings)]
        parts, word = SYLLABLES[alphabet], ""
        for _ in range(2 + attempt // 2):
            word, draw = word + parts[draw % len(parts)], draw // len(parts)
        word += ending
        return word.upper() if value.isupper() and len(value) > 1 else word.capitalize()

    def name(self, kind: str, value: str, attempt: int, alphabet: str) -> str:
        parts, draw = SYLLABLES[alphabet], self.draw(kind, value, attempt)
        word = ""
        for _ in range(3 + attempt // 2):
            word, draw = word + parts[draw % len(parts)], draw // len(parts)
        return word.upper() if value.isupper() and len(value) > 1 else word.capitalize()

    def card(self, value: str, attempt: int) -> str:
        """Keeps the first digit, the separators and whether (and by how much) the check digit fits."""
        digits = [int(c) for c in value if c.isdigit()]
        off = (digits[-1] - luhn(digits[:-1])) % 10
        body = digits[:1] + self.permute(digits[1:-1], 10, "card", digits[0], len(digits), attempt, off)
        new = iter([*body, (luhn(body) + off) % 10])
        return "".join(str(next(new)) if c.isdigit() else c for c in value)


def luhn(digits: list[int]) -> int:
    """The check digit of the digits."""
    total = sum(d * 2 - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(reversed(digits)))
    return -total % 10


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, value, gender) of the corpus; gender is "m" or "f" for given names where most titles say so, else "n"."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen, votes = set(), Counter()
            for t in filter(None, b.column(0).to_pylist()):
                units = {u[:2] for u in Finder.units(t)}
                seen |= units
                if any(kind.startswith("given-") for kind, _ in units):
                    votes.update(Finder.genders(t))
            seen = sorted(seen)
            columns = [pa.array([u[i] for u in seen], pa.string()) for i in range(2)] + [pa.array([votes[*u, g] for u in seen], pa.int64()) for g in "mf"]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "value", "m", "f"])

    votes = map_arrow(docs.select("text"), work, "kind string, value string, m long, f long").groupBy("kind", "value").agg(F.sum("m").alias("m"), F.sum("f").alias("f"))
    return votes.select("kind", "value", F.when(F.col("m") > F.col("f"), "m").when(F.col("m") < F.col("f"), "f").otherwise("n").alias("gender"))


def assigned(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt, gender, surrogate) without collisions within a kind."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        for b in batches:
            rows = [made.surrogate(*row) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.string())], names=["kind", "value", "attempt", "gender", "surrogate"])

    schema = "kind string, value string, attempt int, gender string, surrogate string"
    found = checkpointed(found)
    taken = found.select(F.col("kind").alias("k"), F.col("value").alias("v"))
    done = checkpointed(map_arrow(found.select("kind", "value", F.lit(0).alias("attempt"), "gender"), work, schema))
    for _ in range(MOST_ATTEMPTS):
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "value")) == 1
        real = done.join(taken, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("v")), "left").drop("k")
        state = checkpointed(real.withColumn("fine", first & F.col("v").isNull()).drop("v"))
        if not (lost := state.where("NOT fine")).limit(1).count():
            return done
        again = map_arrow(lost.select("kind", "value", (F.col("attempt") + 1).alias("attempt"), "gender"), work, schema)
        done = checkpointed(state.where("fine").drop("fine").unionByName(again))
    raise RuntimeError("surrogates still collide; give more attempts")


def replaced(docs: DataFrame, key: bytes, count: str | None = None) -> DataFrame:
    """docs with all entities in text replaced; count names a further column with their number."""
    exceptions = checkpointed(assigned(entities(docs), key).where("attempt > 0 OR gender <> 'n'").select("kind", "value", "attempt", "gender"))
    few = exceptions.limit(BROADCAST_ROWS + 1).collect()  # bounded
    source, looked_up = docs, len(few) > BROADCAST_ROWS
    attempts = {} if looked_up else {(r.kind, r.value): (r.attempt, r.gender) for r in few}
    if looked_up:
        source = with_attempts(docs, exceptions)
    at = docs.columns.index("text")
    width = len(docs.columns)
    schema = StructType([*docs.schema.fields, *([StructField(count, LongType())] if count else [])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        for b in batches:
            texts, counts = [], []
            own = b.column(width).to_pylist() if looked_up else None
            for i, t in enumerate(b.column(at).to_pylist()):
                known = {(e["kind"], e["value"]): (e["attempt"], e["gender"]) for e in own[i] or ()} if looked_up else attempts
                units = Finder.units(t) if t else []
                out, last = [], 0
                for kind, value, start, end in units:
                    out += [t[last:start], made.surrogate(kind, value, *known.get((kind, value), ()))]
                    last = end
                texts.append("".join([*out, t[last:]]) if units else t)
                counts.append(len(units))
            columns = [pa.array(texts, b.column(at).type) if i == at else c for i, c in enumerate(b.columns[:width])]
            names = [f.name for f in b.schema][:width]
            if count is not None:
                columns, names = [*columns, pa.array(counts, pa.int64())], [*names, count]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(source, work, schema)


def with_attempts(docs: DataFrame, exceptions: DataFrame) -> DataFrame:
    """docs with the exceptions of each text as a last column, joined by shuffle: the way for many exceptions."""

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = sorted({(h, *u[:2]) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for u in Finder.units(t)})
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["h", "kind", "value"])

    said = map_arrow(docs.select(F.sha2("text", 256).alias("h"), "text"), mentions, "h string, kind string, value string").distinct()
    own = said.join(exceptions, ["kind", "value"]).groupBy("h").agg(F.collect_list(F.struct("kind", "value", "attempt", "gender")).alias("_own"))
    return docs.join(own, F.sha2(docs["text"], 256) == own["h"], "left").select(*[docs[c] for c in docs.columns], own["_own"])
