"""Surrogates for personal data: keyed, of the same type and form, distinct and coreferent.

Entities are e-mail addresses, phone numbers, IPv4 addresses, card and account numbers and names of
persons (behind a title, or a known first name with a surname; in the same text also given names and
surnames found that way where they stand alone). Each is known by a canonical form: an address in lower
case, the digits of a number, a given name or surname in lower case. The surrogate is a keyed function of
type, canonical form and attempt, so an entity gets the same surrogate in every document:

* numbers keep their punctuation, length, leading country code and a valid check digit;
* addresses keep the shape of their parts (letters, digits, dots) and their top-level domain;
* a given name has one gender in the whole table: that of the pool that holds it, else that of the titles
  before it, none where they differ. Its surrogate comes from the pool of that gender and script in the
  first attempts and is made of syllables afterwards, with endings of its gender; without a gender it is
  made of syllables at once. Surnames are made of syllables of the same script; case and title stay.

Not seen are names in capitals only, names without title or known first name, and other kinds of numbers.

Collisions: over all documents every surrogate must stand for one entity and, given names aside, be no entity itself. All
distinct entities are tabled, equal surrogates are found by hash aggregation, and all but one of each
group move on to the next attempt until none collide. Only entities past the first attempt need to be
known when texts are rewritten; that table is broadcast where it has at most ``MOST_BROADCAST`` rows
and joined through the documents' own entities otherwise.

Nulls and edges: null texts stay null; texts without entities stay as they are; rows may repeat or lack
an id, as surrogates depend on content alone; extra columns stay, and the count takes a longer name if one has its own.
"""

import hashlib
import hmac
import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F

from logweave.llm.textscan import extended, slices
from logweave.session import materialize

POOLED = 3  # attempts that draw from the pool of given names
MOST_BROADCAST = 100_000

# Pools of first names by gender and script, and titles by gender.
FIRST_NAMES = {
    ("f", "latin"): "Alice Anna Barbara Carmen Clara Diana Elena Emma Eva Fiona Greta Helen Ines Julia Karin Laura Linda Lucia Maria Marie Mary Nina Olga Paula Rosa Sarah Sofia Susan Teresa Vera".split(),
    ("m", "latin"): "Adam Albert Andrew Bruno Carl Carlos Daniel David Erik Felix Frank Georg Hans Henry Hugo Ivan Jack James John Jorge Karl Louis Luis Mark Max Otto Paul Peter Robert Thomas Tom Victor".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Софья Татьяна".split(),
    ("m", "cyrillic"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
    ("f", "greek"): "Άννα Ελένη Ειρήνη Μαρία Σοφία".split(), ("m", "greek"): "Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Sr Don Господин Κύριος".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Sra Doña Госпожа Κυρία".split(),
    "": "Dr Prof Professor Доктор".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe go ha ka ke ko la le lo ma me mo na ne no pa ra re ro sa se so ta te to va ve wa wi za".split(),
    "cyrillic": "ба бо ва ве го да де ко ла ле ма ме на не но па ра ре ро са со та то".split(),
    "greek": "βα γα δε κα κο λα λε μα με να νο πα ρα ρο σα σο τα το".split(),
}
GIVEN_ENDS = {
    "latin": {"f": "lia na ra".split(), "m": "don mir rus".split(), "": "ley ri".split()},
    "cyrillic": {"f": "лия на ра".split(), "m": "дон мир рус".split(), "": "ли ри".split()},
    "greek": {"f": "λια να ρα".split(), "m": "δων μος ρος".split(), "": "λι ρι".split()},
}
SUFFIXES = {"latin": "n r s ton berg ler".split(), "cyrillic": "нов ров лев ский".split(), "greek": "κης πος δης".split()}

_TITLE_OF = {t: g for g, names in TITLES.items() for t in names}
_GENDER_OF = {n: g for (g, _), names in FIRST_NAMES.items() for n in names}
_ANY = lambda names: "|".join(sorted(map(re.escape, names), key=len, reverse=True))
_CAPITAL = r"[A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫА-ЯЁ][a-zà-öø-ÿά-ώа-яё]+(?:-[A-ZÀ-ÖØ-ÞΑ-ΫА-ЯЁ][a-zà-öø-ÿά-ώа-яё]+)?"
_PERSON = re.compile(rf"\b(?P<title>{_ANY(_TITLE_OF)})\.?\s(?P<given>(?:(?:{_CAPITAL})\s)?)(?P<last>{_CAPITAL})\b"
                     rf"|\b(?P<first>{_ANY(_GENDER_OF)})\s(?P<last2>{_CAPITAL})\b")
_ALONE = re.compile(rf"\b(?:{_CAPITAL}|[A-ZÀ-ÖØ-ÞΑ-ΫА-ЯЁ]{{2,}})\b")
_MAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
_PHONE = re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w(])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\w)")
_CARD = re.compile(r"(?<![\w.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_ANY_DIGITS = re.compile(r"\d\D{0,2}\d\D{0,2}\d")
KINDS = ("email", "ip", "iban", "phone", "card", "person")


def luhn(digits):
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _script(word):
    c = word[:1]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def entities(text):
    """``(start, end, kind, canonical, gender)`` of a text, leftmost first, without overlap."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower(), "") for m in _MAIL.finditer(text)]
    if _ANY_DIGITS.search(text):
        found += [(m.start(), m.end(), "ip", m[0], "") for m in _IP.finditer(text)]
        found += [(m.start(), m.end(), "iban", m[0].replace(" ", ""), "") for m in _IBAN.finditer(text)]
        found += [(m.start(), m.end(), "phone", re.sub(r"\D", "", m[0]), "") for m in _PHONE.finditer(text)]
        found += [(m.start(), m.end(), "card", re.sub(r"\D", "", m[0]), "") for m in _CARD.finditer(text)]
    for m in _PERSON.finditer(text):
        first = (m["given"] or "").strip() or m["first"] or ""
        gender = _GENDER_OF.get(first, "") or _TITLE_OF.get(m["title"] or "", "")
        name = "last" if m["last"] else "last2"
        found.append((m.start(name), m.end(name), "person", m[name].lower(), gender))
        if first:
            at = m.start("given") if m["title"] else m.start("first")
            found.append((at, at + len(first), "given", first.lower(), gender))
    out = _apart(found)
    names = {e[3]: e[2] for e in sorted(out, key=lambda e: e[2]) if e[2] in ("given", "person")}  # surnames prevail
    if names:
        genders = {e[3]: e[4] for e in out if e[2] == "given" and e[4]}
        alone = [(m.start(), m.end(), names[low], low, genders.get(low, "")) for m in _ALONE.finditer(text) if (low := m[0].lower()) in names]
        starts = [e[0] for e in out]
        for e in alone:
            i = bisect_left(starts, e[1])
            if i == 0 or out[i - 1][1] <= e[0]:
                found.append(e)
        out = _apart(found)
    return out


def _apart(found):
    """The leftmost, then longest spans without overlap."""
    out, at = [], 0
    for e in sorted(found, key=lambda e: (e[0], -e[1])):
        if e[0] >= at:
            out.append(e)
            at = e[1]
    return out


class _Stream:
    """Endless keyed choices for one entity and attempt."""

    def __init__(self, key, *parts):
        self.seed, self.n, self.left = hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), 0, b""

    def below(self, n):
        if len(self.left) < 4:
            self.left += hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n

    def pick(self, items):
        return items[self.below(len(items))]

    def like(self, text, keep=0):
        """Characters of the same classes as ``text``; the first ``keep`` stay."""
        pools = {"d": "0123456789", "l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
        return text[:keep] + "".join(self.pick(pools["d"]) if c.isdigit() else self.pick(pools["l"]) if c.islower() else self.pick(pools["u"]) if c.isupper() else c for c in text[keep:])


def _iban_check(country, rest):
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


@lru_cache(maxsize=100_000)
def surrogate(kind, canonical, attempt, key):
    """The canonical form of an entity's surrogate; never the entity itself."""
    while True:
        s = _Stream(key, kind, canonical, attempt)
        if kind == "email":
            local, host = canonical.split("@", 1)
            name, top = host.rsplit(".", 1)
            made = f"{s.like(local)}@{s.like(name)}.{top}"
        elif kind == "ip":
            made = ".".join(str(1 + s.below(254)) for _ in range(4))
        elif kind == "iban":
            body = s.like(canonical[4:])
            made = canonical[:2] + _iban_check(canonical[:2], body) + body
        elif kind == "phone":
            made = s.like(canonical, 1 if len(canonical) > 10 else 0)
        elif kind == "card":
            made = s.like(canonical, 1)
            if luhn(canonical):
                made = next(made[:-1] + d for d in "0123456789" if luhn(made[:-1] + d))
        elif kind.startswith("given"):
            made = _given(s, kind[6:], _script(canonical), canonical, attempt)
        else:
            script = _script(canonical)
            made = "".join(s.pick(SYLLABLES[script]) for _ in range(3 + s.below(2))) + s.pick(SUFFIXES[script])
        if made != canonical:
            return made
        attempt += 1_000_000


def _given(s, gender, script, canonical, attempt):
    """A given name in lower case; names of different gender never meet."""
    pool = sorted({n.lower() for n in FIRST_NAMES.get((gender, script), ())} - {canonical})
    if attempt < POOLED and pool:
        return s.pick(pool)
    return "".join(s.pick(SYLLABLES[script]) for _ in range(2 + s.below(2))) + s.pick(GIVEN_ENDS[script][gender])


def _kind(kind, canonical, attempts):
    """The kind under which an entity is tabled: given names have their gender in it."""
    if kind != "given":
        return kind
    known = _GENDER_OF.get(canonical.capitalize())
    return f"given:{known}" if known else next((k for k in ("given:f", "given:m") if (k, canonical) in attempts), "given:")


def _dress(shown, kind, made):
    """``made`` in the form of the text it replaces: case for names and addresses, punctuation for numbers."""
    if kind in ("phone", "card", "iban"):
        chars = iter(made)
        return "".join(next(chars) if c.isalnum() else c for c in shown)
    if kind in ("person", "given"):
        return made.upper() if shown.isupper() and len(shown) > 1 else made[:1].upper() + made[1:]
    return made.upper() if shown.isupper() else made


def rewrite(text, attempts, key):
    """The text with surrogates, and how many entities it had. ``attempts`` has those past the first, and all given names with a gender."""
    found = entities(text)
    if not found:
        return text, 0
    out, at = [], 0
    for start, end, kind, canonical, gender in found:
        tabled = _kind(kind, canonical, attempts)
        made = surrogate(tabled, canonical, attempts.get((tabled, canonical), 0), key)
        out += [text[at:start], _dress(text[start:end], kind, made)]
        at = end
    return "".join([*out, text[at:]]), sum(e[2] != "given" for e in found)


def entity_table(docs):
    """``kind, canonical`` of all distinct entities of ``docs``; equal ones of a batch are merged early. Given names
    are of kind ``given:`` with their gender."""
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                some = sorted({(e[2], e[3], e[4] if e[2] == "given" else "") for t in part.column("text").to_pylist() if t for e in entities(t)})
                yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in some], pa.string()) for i in range(3)], ["kind", "canonical", "gender"])
    found = docs.select("text").mapInArrow(run, "kind string, canonical string, gender string")
    said = F.nullif("gender", F.lit(""))
    once = found.groupBy("kind", "canonical").agg(F.min(said).alias("a"), F.max(said).alias("b"))
    return once.select(F.when(F.col("kind") == "given", F.concat(F.lit("given:"), F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(""))).otherwise(F.col("kind")).alias("kind"), "canonical")


def _made(key):
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "canonical", "attempt")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(k, c, a, key) for k, c, a in rows], pa.string())], ["kind", "canonical", "attempt", "made"])
    return run


def resolve(found, key):
    """``kind, canonical, attempt`` of the entities whose surrogate is not that of the first attempt, and of given names with a gender.

    A surrogate that is itself an entity and no given name, or that a smaller canonical form (or an earlier settled one)
    has, is given up. Rounds go on until no surrogate is shared.
    """
    table = materialize(found.withColumn("attempt", F.lit(0).cast("long")), "entities")
    while True:
        made = table.mapInArrow(_made(key), "kind string, canonical string, attempt long, made string")
        made = materialize(made, "surrogates")
        owners = made.groupBy("kind", "made").agg(F.min("canonical").alias("owner"), F.count("*").alias("n")).where("n > 1").select("kind", "made", "owner")
        taken = made.join(owners, ["kind", "made"]).where("canonical <> owner").select("kind", "canonical")
        real = made.where("kind NOT LIKE 'given:%'").join(made.select("kind", F.col("canonical").alias("made")), ["kind", "made"], "left_semi").select("kind", "canonical")
        again = materialize(taken.unionByName(real).distinct().withColumn("more", F.lit(1).cast("long")), "collisions")
        if again.isEmpty():
            return table.where("attempt > 0 OR kind IN ('given:f', 'given:m')")
        table = materialize(made.join(again, ["kind", "canonical"], "left").select(
            "kind", "canonical", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")), "entities")


def _free(docs, name):
    while name in docs.columns:
        name += "_"
    return name


def pseudonymise(docs, key, count="n_entities"):
    """``docs`` with surrogates in ``text`` and the number of entities in ``count``. ``key``, bytes, is the secret
    that the surrogates hang on: who knows it can tell which surrogate an entity has."""
    late = materialize(resolve(entity_table(docs), key), "later-attempts")
    count, digest, late_ = (_free(docs, n) for n in (count, "_text_hash", "_late"))
    plain = docs
    if late.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        shared = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["canonical"]): r["attempt"] for r in late.collect()})
        return plain.mapInArrow(_rewriting(key, count, lambda part: [shared.value] * part.num_rows), extended(plain.schema, count, "long"))
    # too many to send everywhere: each text brings those of its own entities, found by its hash
    def own(batches):
        for batch in batches:
            for part in slices(batch):
                rows = [(h, k, c) for h, t in zip(part.column("h").to_pylist(), part.column("text").to_pylist()) if t for k, c in {(k, e[3]) for e in entities(t) for k in (("given:f", "given:m", "given:") if e[2] == "given" else (e[2],))}]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["h", "kind", "canonical"])
    hashed = plain.withColumn(digest, F.sha2("text", 256))
    pairs = hashed.select(F.col(digest).alias("h"), "text").mapInArrow(own, "h string, kind string, canonical string").distinct()
    lists = pairs.join(late, ["kind", "canonical"]).groupBy(F.col("h").alias(digest)).agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias(late_))
    joined = hashed.join(materialize(lists, "late-by-text"), digest, "left").drop(digest)
    listed = lambda part: [{(e["kind"], e["canonical"]): e["attempt"] for e in some or ()} for some in part.column(late_).to_pylist()]
    return joined.mapInArrow(_rewriting(key, count, listed), extended(joined.schema, count, "long")).drop(late_)


def _rewriting(key, count, attempts):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                done = [(None, 0) if t is None else rewrite(t, a, key) for t, a in zip(part.column("text").to_pylist(), attempts(part))]
                at = part.schema.names.index("text")
                texts = pa.array([d[0] for d in done], part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([*part.columns[:at], texts, *part.columns[at + 1:], pa.array([d[1] for d in done], pa.int64())], [*part.schema.names, count])
    return run
