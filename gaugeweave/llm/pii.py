"""PII: surrogate generation.

Detected entities (mail addresses, phone numbers, IPv4 addresses, payment card, account and social security numbers, secrets,
names) get keyed surrogates of the same type and format. Symbols go through a keyed permutation that keeps the class of each
symbol (digit, hexadecimal digit, lower or upper case letter of its script), so different entities of one format get different surrogates without
any table, and equal ones the same one everywhere, whatever way they are written (phone numbers by their digits, addresses and names
whatever their case). Card numbers keep their leading digit and the state of their check digit, account numbers
their country and check digits' state, phone numbers their country code and layout. A listed given name maps to one of the same gender and script;
where that one is taken, and for given names that only a title shows, a name of syllables with an ending of the gender is made, of which
there are enough for any corpus. A family name maps to one made of its script's syllables, so "Mr Smith" and "John Smith" still agree.

Names are runs of capitalised words that begin with a title or a listed given name, that follow a cue ("name:", "Dear", "signed by"), or
whose words make up a mail address of the same text. A part of a name that stands alone elsewhere in the text ("Smith said") is
replaced too. What follows "password" and the like is a secret only if it looks like one (a digit, mixed case, quotes, or "=" without
blanks), so that prose about passwords is left alone. North American numbers are equal with and without +1.

Collision checks: a surrogate that is itself an entity of the corpus, or that two entities share, is drawn again with a
counter until none is left. They run over the distinct entities of all texts as a distributed join; only the few entities with a counter above 0 are
needed when texts are rewritten. They are broadcast after counting, or joined to their documents where there are too many.

Results for odd input: null texts stay null, with 0 entities; empty texts stay empty; texts are used whole; texts without
entities come back unchanged, byte for byte; equal rows get equal results; an empty table gives no rows; all columns of the input are
kept, but for one named as the result's own column of kinds, which gives way to it.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import BROADCAST_BYTES, BROADCAST_ROWS, durable, free_name, text_batches

#: Given names by script and gender, titles by gender, syllables of names by script, and endings of given names by
#: script and gender. Names that are common words or parts of place names are left out of the first.
GIVEN = {
    ("latin", "m"): (
        "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Hans Karl Stefan Pierre Jean Michel Carlos José Luis Juan Miguel Pedro "
        "Joseph Christopher Steven Andrew Kenneth Joshua Kevin Brian Timothy Ronald Edward Jason Jeffrey Ryan Jacob Nicholas Gary Eric Jonathan Stephen Larry Justin Scott "
        "Brandon Benjamin Samuel Gregory Patrick Raymond Alexander Jack Dennis Jerry Tyler Aaron Henry Adam Peter Nathan Zachary Walter Kyle Harold Jeremy Ethan Keith Roger Arthur "
        "Terry Sean Gerald Albert Philip Ralph Bruce Simon Oliver Liam Noah Wolfgang Jürgen Klaus Dieter Uwe Bernd Günter Manfred Helmut Andreas Matthias Markus "
        "Tobias Florian Philipp Johannes Lukas Felix Jonas Jacques Philippe Alain Bernard Thierry Nicolas Laurent Olivier Julien Guillaume François Christophe Frédéric Étienne "
        "Ahmed Mohammed Muhammad Omar Hassan Ibrahim Yusuf Khalid Mustafa Rahul Amit Sanjay Vijay Arjun Rohan Suresh Wei Hiroshi Takashi Kenji Kwame Chidi Tariq Mehmet Emre "
        "Alejandro Javier Sergio Manuel Ramón Andrés Álvaro Jorge Ricardo Eduardo Enrique Roberto Alberto Giovanni Giuseppe Luca Marco Paolo Matteo Piotr Krzysztof Andrzej Tomasz Lars Sven Björn"
    ).split(),
    ("latin", "f"): (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Anna Ursula Petra Marie Claire Sophie María Carmen Isabel Lucía Elena Rosa "
        "Margaret Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Sharon Cynthia Kathleen Amy Angela Shirley Brenda Pamela Emma Nicole "
        "Helen Samantha Katherine Christine Debra Rachel Carolyn Janet Catherine Heather Diane Julie Olivia Joyce Ruth Kelly Lauren Christina Joan Evelyn Judith Megan Alice Ann Hannah "
        "Jacqueline Martha Gloria Teresa Sara Janice Julia Kathryn Monika Sabine Birgit Renate Ingrid Gisela Helga Brigitte Claudia Susanne Gabriele Katrin Heike Anja Silke Katharina "
        "Franziska Johanna Lena Nathalie Isabelle Sylvie Monique Céline Chantal Valérie Véronique Hélène Aurélie Camille Élodie Juliette Margaux Pilar Dolores "
        "Fatima Aisha Priya Anjali Deepa Sunita Lakshmi Kavita Mei Yuki Sakura Amina Zainab Leila Ayşe Elif Natasha Ngozi Amara "
        "Cristina Beatriz Raquel Silvia Marta Paula Sofía Inés Giulia Francesca Chiara Alessandra Valentina Federica Agnieszka Katarzyna Małgorzata Ewa Astrid Sigrid Freya"
    ).split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Николай Андрей Михаил Александр Владимир Виктор Юрий Олег Игорь Павел Борис Максим Артём Константин Григорий Фёдор Кирилл Денис Антон".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Анастасия Людмила Галина Марина Юлия Дарья Валентина Оксана Нина Тамара Лариса Ксения Полина Алина Софья".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παύλος Χρήστος Βασίλης Παναγιώτης Μιχάλης Σταύρος Ανδρέας Θανάσης Σπύρος Στέφανος Πέτρος".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Δήμητρα Βασιλική Γεωργία Παναγιώτα Ειρήνη Χριστίνα Ιωάννα Αγγελική Ευαγγελία Φωτεινή Ζωή".split(),
}
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f", "Señora": "f", "Sra": "f", "Dr": "", "Prof": "", "Professor": "", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
SYLLABLES = {
    "latin": "ba be bi bo bu da de di do du fa fe fi ga go ka ke ki la le li lo lu ma me mi mo mu na ne ni no ra re ri ro sa se si so ta te ti to va ve vi wa we wi".split(),
    "cyrillic": "ба бе ва ве ви га го да де до ка ке ко ла ле ли ма ми мо на не ни ра ри ро са се со та ти".split(),
    "greek": "βα γα δα θα κα λα μα να πα ρα σα τα βο γο δο κο λο μο νο πο ρο σο το".split(),
}
ENDINGS = {
    ("latin", "m"): "bert ric mund fred ston vin".split(),
    ("latin", "f"): "lina ella issa ette inda elle".split(),
    ("cyrillic", "m"): "слав мир дан лад тий рий".split(),
    ("cyrillic", "f"): "слава мира дана лина тия рина".split(),
    ("greek", "m"): "ος ης ας ιος ανος ιλος".split(),
    ("greek", "f"): "ία ίνα ούλα ένη όνη ίτσα".split(),
}

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: In this order; an earlier kind wins where matches overlap. Group 'v' is what is replaced.
PATTERNS = [
    ("secret", re.compile(r"""\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)["']?\s*[=:]\s*["']?(?P<v>[A-Za-z0-9_\-/+.]{6,})""", re.I)),
    ("secret", re.compile(r"\bAKIA(?P<v>[0-9A-Z]{16})\b")),
    ("secret", re.compile(r"\b(?:ghp_|gho_|sk-|xox[bp]-)(?P<v>[A-Za-z0-9-]{16,})")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?P<v>(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}))(?![0-9A-Za-z])")),
    ("email", re.compile(r"(?P<v>[\w.%+-]+@[\w-]+(?:\.[\w-]+)+)")),
    ("iban", re.compile(r"\b(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b")),
    ("ipv4", re.compile(rf"(?<![\d.])(?P<v>(?:{OCTET}\.){{3}}{OCTET})(?!\.?\d)")),
    ("card", re.compile(r"(?<![\d-])(?P<v>\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|3\d{3}[ -]?\d{6}[ -]?\d{5})(?![\d-])")),
    ("phone", re.compile(r"(?<![\w.])(?P<v>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])")),
    ("ssn", re.compile(r"(?<![\d-])(?P<v>\d{3}-\d{2}-\d{4})(?![\d-])")),
]
CAPITAL = r"(?:[OD][’'])?[A-ZÀ-ÖØ-ÞĀ-ŽЀ-ЯΆ-Ϋ][^\W\d_]+(?:[’'-][^\W\d_]+)*"
NAMES = re.compile(rf"(?<!\w){CAPITAL}(?:\.? (?:[A-Z]\. )?{CAPITAL})+")
TOKEN = re.compile(CAPITAL)
ALONE = re.compile(rf"(?<!\w){CAPITAL}")
GAP = re.compile(r" (?:[A-Z]\. )?")
CUE = re.compile(r"(?<!\w)(?:name is|name ?:|signed by|signed ?:|dear|sincerely,|regards,|attn\.?:?|patient ?:|employee ?:|contact ?:|author ?:)\s{1,3}$", re.I)
DIGIT = re.compile(r"[0-9]")
#: A pattern is tried only on texts that hold one of its signs, which every match of it holds: of those without an entry, an ASCII digit.
SIGNS = {1: ("AKIA",), 2: ("ghp_", "gho_", "sk-", "xoxb-", "xoxp-"), 4: ("@",)}
WORDS = ("passw", "pwd", "secret", "token", "api_key", "api-key", "apikey", "access_key", "access-key", "accesskey")
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"]
CLASS_OF = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}
HEX = {c: ("0123456789abcdef", i) for i, c in enumerate("0123456789abcdef")}


def _given() -> dict[str, tuple[str, str, int]]:
    return {n.lower(): (*k, i) for k, names in GIVEN.items() for i, n in enumerate(names)}


GIVEN_OF = _given()
_ORDERS: dict[tuple[bytes, str, str], list[int]] = {}


def _order(key: bytes, script: str, gender: str) -> list[int]:
    """The keyed order of a list of given names."""
    if (key, script, gender) not in _ORDERS:
        _ORDERS[key, script, gender] = sorted(range(len(GIVEN[script, gender])), key=lambda i: hmac.digest(key, f"given|{script}|{gender}|{i}".encode(), hashlib.sha256))
    return _ORDERS[key, script, gender]


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` valid."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits)))
    return -total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _script(c: str) -> str:
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "latin"


def permute(key: bytes, label: str, values: list[int], radices: list[int]) -> list[int]:
    """A keyed permutation of all value lists with these radices: alternately each half is shifted by a function of the other."""
    half, out = len(values) // 2, list(values)
    parts = [range(half), range(half, len(values))] if half else [range(0), range(len(values))]
    for turn in range(8):
        changed, other = parts[turn % 2], parts[1 - turn % 2]
        seed = f"{label}|{turn}|{','.join(map(str, radices))}|{','.join(str(out[i]) for i in other)}".encode()
        stream, block = b"", 0
        while len(stream) < 4 * len(changed):
            stream += hmac.digest(key, seed + block.to_bytes(4), hashlib.sha256)
            block += 1
        for n, i in enumerate(changed):
            out[i] = (out[i] + int.from_bytes(stream[4 * n : 4 * n + 4])) % radices[i]
    return out


def by_class(key: bytes, label: str, text: str, classes: dict | None = None) -> str:
    """``text`` with each symbol exchanged for one of its class; other symbols stay."""
    table = classes or CLASS_OF
    at = [i for i, c in enumerate(text) if c in table]
    got = permute(key, label, [table[text[i]][1] for i in at], [len(table[text[i]][0]) for i in at])
    out = list(text)
    for i, v in zip(at, got, strict=True):
        out[i] = table[text[i]][0][v]
    return "".join(out)


def secretlike(m: re.Match) -> bool:
    """Whether what follows a secret's name is one: words of prose after it are not."""
    value = m["v"]
    if DIGIT.search(value) or (value != value.lower() and value != value.upper() and value[1:] != value[1:].lower()):
        return True
    between = m.group()[: m.start("v") - m.start()]
    return between[-1] in "\"'" or between[-1] == "=" and between[-2] not in " \t"


def _bare(word: str) -> str:
    """A name without the possessive ending."""
    return word[:-2] if word.endswith(("'s", "’s", "'S", "’S")) else word


def _in_mail(first: str, last: str, locals_: list[set[str]]) -> bool:
    a, b = (_ascii(x.lower()) for x in (first, last))
    return any({a, b} <= parts or parts & {a + b, a[:1] + b, b + a} for parts in locals_)


def _ascii(word: str) -> str:
    return unicodedata.normalize("NFKD", word).encode("ascii", "ignore").decode()


def _names(text: str, mails: list[str]) -> list[tuple[int, int, str, str]]:
    """The entities that are parts of names: of full names, and of those that stand alone elsewhere in the text."""
    found, given, family = [], {}, set()
    locals_ = [set(re.split(r"[._\d+-]+", m.partition("@")[0].lower())) for m in mails]
    for m in NAMES.finditer(text):
        tokens = [(t.start() + m.start(), t.start() + m.start() + len(_bare(t.group())), _bare(t.group())) for t in TOKEN.finditer(m.group())]
        i = 0
        while i < len(tokens) - 1:
            word = tokens[i][2]
            known, titled = GIVEN_OF.get(word.lower()), word in TITLES
            j = i + titled
            last = j
            while last < min(len(tokens) - 1, j + 3) and tokens[last + 1][2] not in TITLES and GAP.fullmatch(text, tokens[last][1], tokens[last + 1][0]):
                last += 1
            if not (titled or known and last > j or last > j and (CUE.search(text, max(0, tokens[i][0] - 20), tokens[i][0]) or locals_ and _in_mail(word, tokens[last][2], locals_))):
                i += 1
                continue
            gender = TITLES[word] if titled else known[1] if known else ""
            for n in range(j, last + 1):
                start, stop, t = tokens[n]
                low, own = t.lower(), GIVEN_OF.get(t.lower())
                if n < last:
                    given.setdefault(low, f"{gender or (own[1] if own else '')}:{low}")
                    found.append((start, stop, "given", f"{gender or (own[1] if own else '')}:{low}"))
                else:
                    family.add(low)
                    found.append((start, stop, "family", low))
            i = last + 1
    if found:
        taken = {x[0] for x in found}
        for t in ALONE.finditer(text):
            low = _bare(t.group()).lower()
            if t.start() not in taken and (low in family or low in given):
                found.append((t.start(), t.start() + len(low), *(("family", low) if low in family else ("given", given[low]))))
    return found


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of every entity, in order and apart from each other."""
    found = []
    digit, low = DIGIT.search(text) is not None, text.lower()
    for n, (kind, pattern) in enumerate(PATTERNS):
        if any(w in low for w in WORDS) if n == 0 else any(w in text for w in SIGNS[n]) if n in SIGNS else digit:
            for m in pattern.finditer(text):
                a, b = m.span("v")
                canon = canonical(kind, text[a:b]) if n or secretlike(m) else None
                if canon is not None:
                    found.append((a, b, kind, canon))
    found += _names(text, [x[3] for x in found if x[2] == "email"])
    out, end = [], -1
    for x in sorted(enumerate(found), key=lambda x: (x[1][0], x[0])):
        if x[1][0] >= end:
            out.append(x[1])
            end = x[1][1]
    return out


def canonical(kind: str, value: str) -> str | None:
    """What equal entities share; None if the value isn't of the kind."""
    digits = re.sub(r"\D", "", value)
    if kind == "card":
        return digits if 13 <= len(digits) <= 19 and (luhn(digits[:-1]) == int(digits[-1]) or len(digits) in (15, 16) and digits[0] in "3456") else None
    if kind == "phone":
        if not 9 <= len(digits) <= 15:
            return None
        if len(digits) == 11 and digits[0] == "1" and (value[0] != "+" or re.match(r"\+1(?:\D|\d{10})", value)):
            return f":{digits[1:]}"
        head = re.match(r"\+(\d{1,3})[ .(-]", value)
        return f"{head[1] if head else ''}:{digits[len(head[1]) if head else 0 :]}"
    if kind == "iban":
        flat = value.replace(" ", "")
        return flat if 15 <= len(flat) <= 34 and _mod97(flat) == 1 else None
    if kind == "ipv4":
        return ".".join(str(int(x)) for x in value.split("."))
    return value.lower() if kind == "email" else value


def surrogate(key: bytes, kind: str, canon: str, counter: int = 0) -> str:
    """The canonical form of the entity's surrogate."""
    label = f"{kind}|{counter}"
    if kind == "ipv4":
        return ".".join(map(str, permute(key, label, [int(x) for x in canon.split(".")], [256] * 4)))
    if kind == "card":
        off = (int(canon[-1]) - luhn(canon[:-1])) % 10
        body = canon[0] + by_class(key, label + canon[0], canon[1:-1])
        return body + str((luhn(body) + off) % 10)
    if kind == "phone":
        code, _, rest = canon.partition(":")
        return f"{code}:{by_class(key, label + code, rest)}"
    if kind == "iban":
        body = by_class(key, label + canon[:2], canon[4:])
        return f"{canon[:2]}{98 - _mod97(canon[:2] + '00' + body):02d}{body}"
    if kind == "email":
        local, _, domain = canon.partition("@")
        name, _, top = domain.rpartition(".")
        got = by_class(key, f"{label}|{top}|{len(local)}", local + name)
        return f"{got[: len(local)]}@{got[len(local) :]}.{top}"
    if kind == "secret":
        return by_class(key, label, canon, HEX if set(canon) <= set(HEX) and len(canon) >= 10 else None)
    if kind == "ssn":
        return by_class(key, label, canon)
    gender, _, name = canon.rpartition(":")
    script = _script(name[0])
    if kind == "given" and not counter and GIVEN_OF.get(name, ())[:2] == (script, gender):
        order = _order(key, script, gender)
        return f"{gender}:{GIVEN[script, gender][order[(order.index(GIVEN_OF[name][2]) + 1) % len(order)]].lower()}"
    seed = int.from_bytes(hmac.digest(key, f"{label}|{canon}".encode(), hashlib.sha256)[:16])
    made, syllables = "", SYLLABLES[script]
    for _ in range(max(3, min(6, len(name) // 2)) + counter // 4):
        seed, i = divmod(seed, len(syllables))
        made += syllables[i]
    if kind == "given" and gender:
        made += ENDINGS[script, gender][seed % len(ENDINGS[script, gender])]
    return f"{gender}:{made}" if kind == "given" else made


def dress(kind: str, shown: str, canon: str) -> str:
    """The surrogate's canonical form written as the entity was."""
    if kind in ("card", "phone", "iban"):
        symbols, own = canon.replace(":", ""), [c for c in shown if c.isalnum()]
        it = iter([*own[: len(own) - len(symbols)], *symbols])  # a country code that the canonical form leaves out stays
        return "".join(next(it) if c.isalnum() else c for c in shown)
    if kind == "email":
        return "".join(c.upper() if s.isupper() else c for s, c in zip(shown, canon, strict=True)) if len(shown) == len(canon) else canon
    if kind in ("given", "family"):
        name = canon.rpartition(":")[2]
        return name.upper() if shown.isupper() and len(shown) > 1 else name[:1].upper() + name[1:]
    return canon


def rewrite(key: bytes, text: str, counters: dict) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds that were replaced."""
    out, at, kinds = [], 0, []
    for a, b, kind, canon in find(text):
        new = surrogate(key, kind, canon, counters.get((kind, canon), 0))
        out += [text[at:a], dress(kind, text[a:b], new)]
        at = b
        kinds.append(kind)
    return ("".join([*out, text[at:]]), kinds) if kinds else (text, kinds)


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct (kind, canon) of all texts, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = {(kind, canon) for t in b.column(0).to_pylist() if t for _, _, kind, canon in find(t)}
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in seen], pa.string()), pa.array([x for _, x in seen], pa.string())], names=["kind", "canon"])

    return durable(text_batches(docs).select(text_col).mapInArrow(run, "kind string, canon string").distinct())


def redrawn(found: DataFrame, key: bytes, most_rounds: int = 1000) -> DataFrame:
    """(kind, canon, counter) of the entities whose surrogate had to be drawn again, stored. It draws until all are distinct and none is an original, and raises if ``most_rounds`` don't do."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, canons, counters = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([surrogate(key, *x) for x in zip(kinds, canons, counters, strict=True)], pa.string())], names=["kind", "canon", "counter", "made"])

    schema = "kind string, canon string, counter int, made string"
    drawn = durable(found.select("kind", "canon", F.lit(0).alias("counter")).mapInArrow(draw, schema))
    originals = found.select("kind", F.col("canon").alias("made"), F.lit(True).alias("taken"))
    counter = 0
    while True:
        first = drawn.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min(F.struct("counter", "canon")).alias("keeps")).filter("n > 1").select("kind", "made", "keeps")
        bad = drawn.join(originals, ["kind", "made"], "left").join(first, ["kind", "made"], "left")
        bad = durable(bad.filter(F.col("taken").isNotNull() | (F.col("keeps.canon") != F.col("canon"))).select("kind", "canon", (F.col("counter") + 1).alias("counter")))
        if bad.isEmpty():
            return durable(drawn.filter("counter > 0").select("kind", "canon", "counter"))
        counter += 1
        if counter > most_rounds:
            raise ValueError(f"no free surrogates are left for some entities, such as a {bad.first().kind}: the corpus holds nearly all values of its format")
        drawn = durable(drawn.join(bad.select("kind", "canon"), ["kind", "canon"], "left_anti").unionByName(bad.mapInArrow(draw, schema)))


def with_surrogates(docs: DataFrame, key: str = "surrogates", text_col: str = "text", id_col: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS, kinds_col: str = "pii_kinds") -> DataFrame:
    """``docs`` with the rewritten text, and with ``kinds_col``, the kinds replaced in order."""
    secret = key.encode()
    again = redrawn(entities(docs, text_col), secret)
    names = [c for c in docs.columns if c.lower() != kinds_col.lower()]
    docs = docs.select(*(f"`{c}`" for c in names))
    extra, own_id = free_name(names, "_again"), free_name(names, "_id")
    n, size = again.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("canon")), F.lit(0))).first()
    if n <= broadcast_rows and size <= BROADCAST_BYTES:
        counters = docs.sparkSession.sparkContext.broadcast({(r.kind, r.canon): r.counter for r in again.collect()})
        rows = docs
    else:
        counters = None

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = {(i, kind, canon) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for _, _, kind, canon in find(t)}
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), *(pa.array([x[n] for x in got], pa.string()) for n in (1, 2))], names=[own_id, "kind", "canon"])

        mine = docs.select(id_col, text_col).mapInArrow(pairs, f"{own_id} long, kind string, canon string").distinct().join(again, ["kind", "canon"])
        mine = mine.groupBy(own_id).agg(F.collect_list(F.struct("kind", "canon", "counter")).alias(extra))
        rows = docs.join(mine, docs[id_col].eqNullSafe(mine[own_id]), "left").drop(own_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = counters.value if counters is not None else None
        for b in batches:
            at = b.schema.get_field_index(text_col)
            own = b.column(b.schema.get_field_index(extra)).to_pylist() if shared is None else [None] * b.num_rows
            got = [(None, []) if t is None else rewrite(secret, t, shared if shared is not None else {(x["kind"], x["canon"]): x["counter"] for x in o or []}) for t, o in zip(b.column(at).to_pylist(), own, strict=True)]
            columns = [pa.array([t for t, _ in got], pa.string()) if n == text_col else b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([k for _, k in got], pa.list_(pa.string()))], names=[*names, kinds_col])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{kinds_col}` array<string>"])
    return rows.mapInArrow(run, schema)
