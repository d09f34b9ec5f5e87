"""Problem 5: personal information inside free text, found by weak supervision and replaced by placeholders.

Method. Regular expressions, the name gazetteer and context cues propose spans, and each labeler votes on
each span of its kind (yes, no, abstain). All spans of the corpus are counted by their pattern (votes and
discrete features); expectation-maximisation over these counts estimates how reliable each labeler is, and a
logistic span classifier is trained on the resulting probabilities, with the labelers' features and the
context features as input. The classifier decides every pattern, and so every span.

The patterns are combinations of a fixed set of votes and features, so their number does not grow with the
corpus; counts come from all spans of all texts, nothing is sampled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesieve.llm.lookalike import plain_with_offsets
from lakesieve.session import materialize

#: Words of one name; a longer span is parted into persons.
NAME_WORDS = 4
KINDS = ("email", "phone", "idnumber", "address", "name")
# Words that surround the kinds, names of form fields, and kinds of streets.
STREETS = "street|st|road|rd|avenue|ave|lane|ln|way|court|ct|crescent|close|terrace|boulevard|blvd|drive|square|place|row|gardens"
FIELD_KINDS = {
    "email": {"email", "e-mail", "mail", "your-email", "email_address", "contact_email"},
    "phone": {"phone", "tel", "mobile", "telephone", "cell", "phone_number", "fax"},
    "address": {"address", "ship_to", "street", "shipping_address", "billing_address", "delivery_address", "home_address"},
    "name": {"name", "full_name", "your-name", "contact", "first_name", "last_name", "fullname", "recipient"},
    "idnumber": {"ssn", "passport", "id_number", "tax_id", "national_id", "ni_number"},
}
NOT_NAMES = {
    "sales", "desk", "test", "tester", "webmaster", "anonymous", "null", "none", "n/a", "na", "admin", "administrator", "user", "customer",
    "support", "team", "crew", "info", "office", "yes", "no", "the", "unknown", "hello", "hi", "me", "nobody", "guest", "manager", "ltd", "works",
    "inc", "club", "group", "company", "service", "services", "help", "on", "of", "list", "not", "all", "everyone", "you", "your", "our", "my", "a", "an",
}

_EMAIL = re.compile(r"(?:mailto:)?([a-z0-9][a-z0-9._%+\-]*)(?:( ?(?:@|\(at\)|\[at\]) ?)([a-z0-9\-]+(?:(?:\.|\(dot\)|\[dot\])[a-z0-9\-]+)*(?:\.|\(dot\)|\[dot\])[a-z]{2,})|( at )([a-z0-9\-]+(?: dot [a-z0-9\-]+)* dot [a-z]{2,}))")
_EMAIL_CUE = re.compile(r"(?:e-?mail|mail|write to|reach me at|escriban a|\bcc|copy to|account of|address)[:= ]*\(?$")
_EMAIL_AFTER = re.compile(r"^[ .,]*(?:is the best way|and nobody else|please|instead|is locked|\))")
_PHONE = re.compile(r"(?<![\w#@\-/.+])(?:\+?\(?\d(?:\d| (?=[\d(])|[.\-/](?=\d)|[()](?=[ \d(\-./])){5,20}(?<=\d))(?![\w@]*[a-z@_])(?:\s?(?:ext\.?|x)\s?\d{1,5}\b)?")
_PHONE_SHAPES = (
    re.compile(r"\+\d{1,3}(?:[ \-.]?\(?\d{1,5}\)?){1,6}"), re.compile(r"\(\d{3}\) ?\d{3}[ \-.]\d{4}"), re.compile(r"\d{3}([.\- ])\d{3}\1\d{4}"),
    re.compile(r"1([/.\- ])\d{3}\1\d{3}[\-./ ]\d{4}"), re.compile(r"0\d{9,10}"), re.compile(r"0\d{3,4} \d{6,7}"), re.compile(r"00\d{1,3} ?(?:\(0\) ?)?\d{2,5}(?: ?\d{2,6}){1,4}"),
    re.compile(r"0\d(?: \d\d){4}"), re.compile(r"\d{3}-\d{4}"), re.compile(r"0\d{2,4}[ /\-]\d{3,4}[ \-]?\d{3,4}"),
)
_NOT_PHONE = re.compile(r"\d{3}[- ]\d{2}[- ]\d{4}|\d{2}-\d{7}|\d{4}-\d{2}-\d{2}.*|\d{1,3}(?:\.\d{1,3}){3}|[1-9]\d{9}")
_PHONE_CUE = re.compile(r"(?:tel|telefon|telephone|phone|mobile|fax|call me on|call|text|sms|number is|num[eé]ro|whatsapp or ring|ring|picked up at|reach me (?:on|at))[.:= ]*$")
_PHONE_AFTER = re.compile(r"^[ .,]*(?:after six|if nobody|works on weekdays|today)")
_NUMBER_TRAP = re.compile(r"(?:epoch value was|list of|order|section|ref|id|version|build|step|ssn|passport[a-z .#]*|identity number|tax id|ni number)[:=# ]*$")
_ID = re.compile(
    r"(?<![\w#@\-])(?:(ssn[ :#]*\d{3}[- ]?\d{2}[- ]?\d{4})|(\d{3}-\d{2}-\d{4})|(\d{3} \d{2} \d{4})|((?:ni number|nino)[ :#]*[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d])|([a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d])"
    r"|(passport(?: number| no\.?| #|:)?[ :#]*[a-z]{0,2}\d{6,9})|((?:national identity number|identity number|national id|id card)(?: number| no\.?| #|:)?[ :#]*\d{8,14})|(tax id(?: number)?[ :#]*\d{2}-?\d{7}))(?![\w\-@])"
)
_ID_WORDS = ("ssn", "passport", "identity", "tax id", "ni number", "national id", "nino", "id card")
_ID_DIGITS = re.compile(r"\d\d(?:[- ]\d{4}| ?[a-d]\b)")
_ID_CUE = re.compile(r"(?:asked for|check use|enclosed:?|typed|papers say|number|ssn|id)[:= ]*$")
_ID_AFTER = re.compile(r"^[ .,]*on the form")
_ADDRESS = re.compile(
    rf"(?<![\w\-#])(?:((?:(?:flat|apt|unit|suite)\.? ?\d+\w?,? )?(?:no\.? ?)?\d{{1,5}}[a-z]?,? (?:[nsew]\.? )?[a-z'\-]{{3,}}(?: [a-z'\-]{{3,}})? (?:{STREETS})\b\.?(?:, apt\.? ?\d+\w?|, flat ?\d+)?(?:, [a-z]+(?=[,.;!?)]|$| [a-z_\-]+=|,? [a-z]{{1,2}}\d))?(?:,? [a-z]{{1,2}}\d{{1,2}} ?\d[a-z]{{2}})?)"
    r"|(\d{1,4}(?: ?(?:bis|ter))?,? rue (?:de la |de l'|des |du |de )?[a-zà-ÿ'\-]+)|((?:calle|avenida|plaza) (?:de la |del |de )?[a-zà-ÿ]+,? \d{1,4}(?:, \d+[oºª]? ?[a-z]?\b)?)|([a-zà-ÿ]{3,}(?:stra(?:ß|ss)e|str\.|weg|gasse|allee|platz) \d{1,4}[a-z]?)"
    r"|((?:p\.?o\.? box|postfach|apartado) \d{1,6}))(?![\w])"
)
_ADDRESS_HINT = tuple(f" {s}" for s in STREETS.split("|")) + ("rue ", "calle ", "avenida ", "plaza ", "straße", "strasse", "str.", "weg ", "gasse ", "allee ", "platz ", "box ", "postfach ")
_KINDS_OF_STREET = set(STREETS.split("|")) | {"flat", "apt", "unit", "suite"}
_ADDRESS_CUE = re.compile(r"(?:address|deliver it to|ship everything to|live at|moved from|van stops at|meet us outside|ship_to)[:= ]*$")
_ADDRESS_AFTER = re.compile(r"^[ .,]*(?:please|since|in march|is where it broke)")
_W = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_NAME_SLOTS = (
    ("parcel for ", re.compile(rf"\bparcel for ({_W}(?: {_W}\.?)?(?: {_W})?) came back")), ("signed by", re.compile(rf"\bsigned by:? ({_W}\.?,? {_W}(?: {_W})?)")),
    ("y name is ", re.compile(rf"\bmy name is ({_W}\.?,? {_W}(?: {_W})?)")), ("full name", re.compile(rf"\bfull name:? ({_W}\.?,? {_W}(?: {_W})?)")),
    ("name ist ", re.compile(rf"\bmein name ist ({_W}\.?,? {_W}(?: {_W})?)")), ("e llamo ", re.compile(rf"\bme llamo ({_W}\.?,? {_W}(?: {_W})?)")),
    ("'appelle ", re.compile(rf"\bm'appelle ({_W}\.?,? {_W}(?: {_W})?)")), ("this is ", re.compile(rf"\bthis is ({_W}\.? {_W}(?: {_W})?) from the")),
    ("told me to ", re.compile(rf"(?:^|[.!?=;:)|,] ?|\s)({_W}\.?,? {_W}) told me to write")), ("ask for ", re.compile(rf"\bask for ({_W}\.?,? {_W}(?: {_W})?) at the desk")),
    ("spoke with ", re.compile(rf"\bspoke with ({_W}\.?,? {_W}(?: {_W})?) and then")), ("and then with ", re.compile(rf"\band then with ({_W}(?: {_W})?) again")),
    (" says the ", re.compile(rf"(?:^|[.!?=;:)|,] ?|\s)({_W}) says the \S+ is fine")), ("already know", re.compile(rf"\b(?:mr|mrs|ms|miss|dr)\.? ({_W}(?: {_W})?) already know")),
    ("egards, ", re.compile(rf"\bregards,? ({_W}\.?,? {_W})")), ("incerely, ", re.compile(rf"\bsincerely,? ({_W}\.?,? {_W})")), ("heers, ", re.compile(rf"\bcheers,? ({_W}\.?,? {_W})")),
    ("hanks, ", re.compile(rf"\bthanks,? ({_W}\.?,? {_W})")), ("ours, ", re.compile(rf"\byours,? ({_W}\.?,? {_W})")), ("ishes, ", re.compile(rf"\bwishes,? ({_W}\.?,? {_W})")),
)
_TITLE = re.compile(r"\b(?:mr|mrs|ms|miss|dr|herr|frau|señor|señora|monsieur|madame)\.? $")
_BREAKS = ".,;:!?()=\"-'’|/\n"
_TOKEN = re.compile(r"[^\W\d_]+")
_FIELD = re.compile(r"(?:^|\s)([a-z_][a-z_\-]*)=")

# A pattern is "kind|votes|features"; votes are one character per labeler: + yes, - no, . abstain.


def _split(s: str) -> list[str]:
    """The words of ``s`` between blanks and the usual punctuation."""
    for c in _BREAKS:
        if c in s:
            s = s.replace(c, " ")
    return s.split()


def _cues(s: str, start: int, end: int, before: re.Pattern, after: re.Pattern) -> str:
    return "b" * bool(before.search(s[max(0, start - 24) : start])) + "a" * bool(after.match(s[end : end + 24]))


def _field_at(fields: list[tuple[int, str]], place: str, start: int) -> str:
    """The form field that offset ``start`` lies in: the place, or for joined forms the last ``key=`` before it."""
    name = place
    for at, key in fields:
        if at > start:
            break
        name = key
    return name


def _vote(yes: bool, no: bool = False) -> str:
    return "+" if yes else "-" if no else "."


class Labelers:
    """Proposes spans of personal information with the labelers' votes."""

    def __init__(self, names: list[tuple[str, str]], ordinary: set[str]) -> None:
        self.given = {n.lower() for n, k in names if k == "given" and n}
        self.family = {n.lower() for n, k in names if k == "family" and n}
        self.names = self.given | self.family
        self.ordinary = ordinary

    def spans(self, text: str, place: str) -> list[tuple[str, str, int, int]]:
        """(kind, pattern, start, end) of the proposals in ``text``; offsets count characters of ``text``."""
        clean, at = plain_with_offsets(text)
        s = clean.lower()
        if len(s) != len(clean):
            s = "".join(c.lower() if len(c.lower()) == 1 else c for c in clean)
        fields = [(m.start(1), m.group(1)) for m in _FIELD.finditer(s)] if place == "normalized" and "=" in s else []
        found: list[tuple[str, str, int, int]] = []
        taken: list[tuple[int, int]] = []
        if "@" in s or "(at)" in s or "[at]" in s or (" at " in s and " dot " in s):
            self._emails(s, place, fields, found, taken)
        if any(c in s for c in "0123456789"):
            if any(w in s for w in _ID_WORDS) or _ID_DIGITS.search(s):
                self._ids(s, place, fields, found, taken)
            self._phones(s, place, fields, found, taken)
            if any(h in s for h in _ADDRESS_HINT):
                self._addresses(s, place, fields, found, taken)
        self._names(s, clean, place, fields, found, taken)
        if at is None:
            return found
        return [(k, p, at[b], at[e - 1] + 1) for k, p, b, e in found if e > b]

    @staticmethod
    def _free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
        return all(end <= a or start >= b for a, b in taken)

    def _emails(self, s, place, fields, found, taken) -> None:
        for m in _EMAIL.finditer(s):
            glue, domain = m.group(2) or m.group(4), m.group(3) or m.group(5)
            words = glue == " at "
            cue = _cues(s, m.start(), m.end(), _EMAIL_CUE, _EMAIL_AFTER)
            key = _field_at(fields, place, m.start()) in FIELD_KINDS["email"]
            votes = _vote(glue == "@" and "dot" not in domain) + _vote(glue != "@" or "dot" in domain) + _vote(bool(cue)) + _vote(key) + _vote(len(m.group(1)) >= 3)
            found.append(("email", f"email|{votes}|{'w' if words else 's'}{cue}", m.start(), m.end()))
            taken.append((m.start(), m.end()))

    def _ids(self, s, place, fields, found, taken) -> None:
        for m in _ID.finditer(s):
            which = m.lastindex or 0
            if not self._free(taken, m.start(), m.end()):
                continue
            cue = _cues(s, m.start(), m.end(), _ID_CUE, _ID_AFTER)
            phone = bool(_PHONE_CUE.search(s[max(0, m.start() - 24) : m.start()]))
            key = _field_at(fields, place, m.start()) in FIELD_KINDS["idnumber"]
            labelled = which in (1, 4, 6, 7, 8)
            votes = _vote(labelled) + _vote(which in (2, 5)) + _vote(bool(cue)) + _vote(key, phone)
            found.append(("idnumber", f"idnumber|{votes}|{which}{cue}", m.start(), m.end()))
            taken.append((m.start(), m.end()))

    def _phones(self, s, place, fields, found, taken) -> None:
        for m in _PHONE.finditer(s):
            start, end = m.start(), m.end()
            body = re.sub(r"\s?(?:ext\.?|x)\s?\d{1,5}$", "", m.group())
            digits = sum(c.isdigit() for c in body)
            if not 7 <= digits <= 15 or not self._free(taken, start, end):
                continue
            shape = next((i for i, p in enumerate(_PHONE_SHAPES) if p.fullmatch(body)), -1)
            cue = _cues(s, start, end, _PHONE_CUE, _PHONE_AFTER)
            trap = bool(_NUMBER_TRAP.search(s[max(0, start - 28) : start]))
            key = _field_at(fields, place, start) in FIELD_KINDS["phone"]
            votes = _vote(shape >= 0, shape < 0) + _vote(bool(cue)) + _vote(key) + _vote(False, trap) + _vote("+" in body or "ext" in m.group(), bool(_NOT_PHONE.fullmatch(body)))
            found.append(("phone", f"phone|{votes}|{shape}{cue}", start, end))
            taken.append((start, end))

    def _addresses(self, s, place, fields, found, taken) -> None:
        for m in _ADDRESS.finditer(s):
            if not self._free(taken, m.start(), m.end()):
                continue
            which = m.lastindex or 0
            cue = _cues(s, m.start(), m.end(), _ADDRESS_CUE, _ADDRESS_AFTER)
            key = _field_at(fields, place, m.start()) in FIELD_KINDS["address"]
            rich = bool(re.search(r"flat|apt|no\.|, ", m.group()))
            words = m.group().split()
            inner = re.sub(r"[^a-z ]", "", m.group(1) or "x y").split()
            kinds_only = which == 1 and len([w for w in inner if len(w) > 2 and w not in _KINDS_OF_STREET]) == 0
            filler = kinds_only or bool({"the", "a", "of", "and", "our", "on", "in", "for", "with"} & set(words))
            votes = _vote(which == 1 and not filler, filler) + _vote(which > 1) + _vote(bool(cue)) + _vote(key) + _vote(rich)
            found.append(("address", f"address|{votes}|{which}{cue}{'f' * filler}", m.start(), m.end()))
            taken.append((m.start(), m.end()))

    def _persons(self, s: str, start: int, end: int) -> list[tuple[int, int]]:
        """The span, or its persons if it has more than NAME_WORDS words: parted at commas (but not in "family,
        given") and before what follows a given with a family name. A part may still be long."""
        words = [(m.start() + start, m.end() + start, m.group().split("-")[0]) for m in re.finditer(r"[^\s,.]+", s[start:end])]
        if len(words) <= NAME_WORDS:
            return [(start, end)]
        parts = [[words[0]]]
        for last, word in zip(words, words[1:], strict=False):
            now = [w for _, _, w in parts[-1]]
            whole = len(now) > 1 and any(w in self.given for w in now) and any(w in self.family for w in now)
            turned = len(now) == 1 and now[0] in self.family and word[2] in self.given
            comma = "," in s[last[1] : word[0]]
            if (comma and not turned) or (whole and word[2] in (self.family if now[0] in self.family else self.given)):
                parts.append([word])
            else:
                parts[-1].append(word)
        return [(p[0][0], p[-1][1]) for p in parts]

    def _names(self, s, clean, place, fields, found, taken) -> None:
        key_place = place in FIELD_KINDS["name"]
        slots: list[tuple[int, int]] = []
        for hint, pattern in _NAME_SLOTS:
            if hint in s:
                slots += [m.span(1) for m in pattern.finditer(s)]
        hit = self.names.intersection(_split(s))
        hits = len(hit) > 1 or bool(hit - self.ordinary)  # a single ordinary word is a name in its slot only
        name_fields = [(a, k) for a, k in fields if k in FIELD_KINDS["name"]]
        if not (hits or slots or key_place or name_fields):
            return
        spans = list(slots)
        if key_place:
            spans.append((0, len(s)))
        for a, key in name_fields:
            nxt = next((b for b, _ in fields if b > a), len(s) + 1)
            spans.append((a + len(key) + 1, max(a + len(key) + 1, min(len(s), nxt - 1))))
        tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(s)] if hits else []
        run: list[tuple[int, int, str]] = []
        runs: list[tuple[int, int]] = []
        for t in [*tokens, (10**9, 10**9, "")]:
            known = t[2] in self.names
            gap = s[run[-1][1] : t[0]] if run and known else None
            if known and gap is not None and gap in (" ", ", ", "-"):
                run.append(t)
                continue
            if run:
                runs.append((run[0][0], run[-1][1]))
            run = [t] if known else []
        runs = [p for x in runs for p in self._persons(s, *x)]
        spans = [p for x in spans for p in self._persons(s, *x)]
        covered: list[tuple[int, int]] = []
        for a, b in [*spans, *runs]:
            while a < b and not s[a].isalpha():
                a += 1
            while b > a and not s[b - 1].isalpha():
                b -= 1
            if a >= b or not self._free(covered, a, b) or not self._free(taken, a, b):
                continue
            if s[max(0, a - 1) : a] in tuple("@_+/#&") or s[b : b + 1] in tuple("@_+/") or (s[a - 1 : a] == "." and a > 1 and s[a - 2].isalnum()):
                continue
            words = [w for w in re.split(r"[\s,.]+", s[a:b]) if w]
            parts = [p for w in words for p in w.split("-")]
            if not words:
                continue
            long = len(words) > NAME_WORDS
            slot = any(a >= x and b <= y for x, y in slots)
            field = place in FIELD_KINDS["name"] or (bool(name_fields) and _field_at(fields, place, a) in FIELD_KINDS["name"] and (a, b) not in runs)
            known = [p in self.names for p in parts]
            common = [p in self.ordinary for p in parts]
            stop = any(p in NOT_NAMES and len(p) > 1 for p in parts) or parts[0] in NOT_NAMES or not all(re.fullmatch(r"[^\W\d_]+", p) for p in parts)
            pair = len(parts) > 1 and any(p in self.given for p in parts) and any(p in self.family for p in parts)
            sure = any(k and not c for k, c in zip(known, common, strict=True))
            title = bool(_TITLE.search(s[max(0, a - 10) : a]))
            case = clean[a:b] != s[a:b]
            upper = place == "normalized" or all(w[:1].isupper() for w in clean[a:b].split())
            shaped = len(parts) > 1 and not stop and not all(common) and upper
            votes = _vote(shaped) + _vote(pair) + _vote(False, stop) + _vote(sure, all(common) and not pair) + _vote((slot or title) and not stop) + _vote(field and not stop) + _vote(place != "normalized" and case and any(known), not any(known) and not slot and not field)
            found.append(("name", f"name|{votes}|{min(len(words), 3)}{'l' * long}{'k' * all(known)}{'s' * stop}{'c' * all(common)}", a, b))
            if not long:  # the names within a long one are proposed as well, as it may be rejected
                covered.append((a, b))


def values_of(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(request_id, place, text, th): every field value and every normalized text that is not blank, and a hash of it."""
    fields = requests.where("request_id is not null and fields is not null").select(F.col("request_id").cast("long").alias("request_id"), F.explode("fields").alias("place", "text"))
    texts = results.where("request_id is not null").select(F.col("request_id").cast("long").alias("request_id"), F.lit("normalized").alias("place"), F.col("normalized").alias("text"))
    return fields.unionByName(texts).where("text is not null and text <> ''").withColumn("th", F.xxhash64("text"))


def _labeled(names: list[tuple[str, str]], ordinary: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labelers = Labelers(names, ordinary)
        for batch in batches:
            out: list[tuple] = []
            for i, place, text, th in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for kind, pattern, start, end in labelers.spans(text, place):
                    out.append((i, place, th, kind, pattern, start, end))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["request_id", "place", "th", "kind", "pattern", "start", "end"])

    return run


def ordinary_names(requests: DataFrame, names: list[tuple[str, str]]) -> set[str]:
    """Names of the list that are also ordinary words: those mostly written in lower case in the field values.

    Counted over all field values; the result is at most as long as the list of names.
    """
    known = sorted({n.lower() for n, _ in names if n})
    if not known:
        return set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[str, int] = {}
        high: dict[str, int] = {}
        wanted = set(known)
        token = re.compile(r"(?<![\w@.+\-])[^\W\d_]+(?![\w@]|[.+\-]\w)")
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if wanted.isdisjoint(_split(text.lower())):
                    continue
                for w in token.findall(text):
                    if w in wanted:
                        low[w] = low.get(w, 0) + 1
                    elif w.lower() in wanted and not w.isupper():
                        high[w.lower()] = high.get(w.lower(), 0) + 1
        both = sorted(set(low) | set(high))
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([low.get(w, 0) for w in both], pa.int64()), pa.array([high.get(w, 0) for w in both], pa.int64())], ["name", "low", "high"])

    texts = requests.where("fields is not null").select(F.explode(F.map_values("fields")).alias("text")).where("text is not null")
    counts = texts.mapInArrow(run, "name string, low long, high long").groupBy("name").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    return {r["name"] for r in counts.collect() if r["low"] > 0.2 * r["high"]}


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, prior: float = 0.7, rounds: int = 60) -> np.ndarray:
    """Probability of yes for every vote pattern. votes: [patterns, labelers] of 1, 0, -1; counts: [patterns].

    Each labeler has its own chances of voting yes or no on true and on false spans; abstaining says nothing. The start is
    the balance of the votes, weighted by the counts; each round re-estimates the chances (with a small prior
    that keeps a yes more likely for true spans) and the probabilities.
    """
    balance = (votes == 1).sum(1) - 2.0 * (votes == -1).sum(1)
    p = np.clip(prior + 0.28 * np.sign(balance) * np.minimum(1, np.abs(balance) / 2) - 0.4 * (balance < 0), 0.02, 0.98)
    steps = (1, -1)
    for _ in range(rounds):
        score = np.zeros(len(p))  # true and false spans are equally likely before the votes
        for j in range(votes.shape[1]):
            voted = votes[:, j] != 0
            for step, base_yes, base_no in zip(steps, (0.95, 0.05), (0.2, 0.8), strict=True):
                here = votes[:, j] == step
                size = 0.05 * counts.sum()
                yes = ((counts * p)[here].sum() + base_yes * size) / ((counts * p)[voted].sum() + size)
                no = ((counts * (1 - p))[here].sum() + base_no * size) / ((counts * (1 - p))[voted].sum() + size)
                ratio = np.log(yes / no)
                score[here] += max(ratio, 0.3) if step > 0 else min(ratio, -1.5)  # a yes never counts against, a no never for
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(new - p).max() < 1e-5:
            p = new
            break
        p = new
    return p


def _features(pattern: str) -> list[str]:
    kind, votes, rest = pattern.split("|")
    return [f"{kind}{i}{v}" for i, v in enumerate(votes)] + [f"{kind}:{rest}"]


def train_classifier(patterns: list[tuple[str, int]], rounds: int = 2000) -> dict[str, float]:
    """Probability of every pattern by a logistic classifier trained on the EM's probabilities.

    patterns: (pattern, number of spans), all of the corpus.
    """
    result: dict[str, float] = {}
    for kind in KINDS:
        mine = sorted((p, n) for p, n in patterns if p.startswith(f"{kind}|"))
        if not mine:
            continue
        counts = np.array([n for _, n in mine], dtype=float)
        votes = np.array([[{"+": 1, "-": -1}.get(v, 0) for v in p.split("|")[1]] for p, _ in mine])
        target = expectation_maximisation(votes, counts)
        names = sorted({f for p, _ in mine for f in _features(p)})
        index = {f: i for i, f in enumerate(names)}
        x = np.zeros((len(mine), len(names) + 1))
        x[:, -1] = 1
        for r, (p, _) in enumerate(mine):
            x[r, [index[f] for f in _features(p)]] = 1
        weight = np.sqrt(counts) / np.sqrt(counts).sum()
        theta = np.zeros(x.shape[1])
        for _ in range(rounds):
            guess = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            theta -= 0.5 * (x.T @ (weight * (guess - target)) + 1e-4 * theta)
        guess = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        result.update({p: float(g) for (p, _), g in zip(mine, guess, strict=True)})
    return result


def detected(requests: DataFrame, results: DataFrame, person_names: DataFrame, least: float = 0.5, most_names: int = 1_000_000) -> DataFrame:
    """(request_id, place, th, kind, start, end) of every span that the classifier accepts, materialised.

    ``place`` is a key of ``fields`` or ``normalized``. Offsets count code points of the value. Null, empty and
    blank values have no spans; null names are ignored; rows that repeat a request repeat its spans.
    ``most_names`` bounds the reference list, which every task holds.
    """
    names = [(r["name"], r["kind"]) for r in person_names.where("name is not null").select("name", "kind").limit(most_names + 1).collect()]
    if len(names) > most_names:
        raise ValueError("the list of names is too long to be held by every task")
    ordinary = ordinary_names(requests, names)
    spans = materialize(values_of(requests, results).mapInArrow(_labeled(names, ordinary), "request_id long, place string, th long, kind string, pattern string, start int, end int"), "spans")
    counts = [(r["pattern"], r["count"]) for r in spans.groupBy("pattern").count().collect()]  # bounded by the votes and features
    accepted = [p for p, g in train_classifier(counts).items() if g >= least]
    return spans.where(F.col("pattern").isin(accepted)).select("request_id", "place", "th", "kind", "start", "end")


def found_places(requests: DataFrame, results: DataFrame, person_names: DataFrame) -> DataFrame:
    """(request_id, place, kind): one row for each place with at least one piece of the kind."""
    return detected(requests, results, person_names).select("request_id", "place", "kind").distinct()


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            done, last = [], 0
            for s in sorted(spans or [], key=lambda s: (s["start"], -s["end"])):
                if s["start"] < last:  # overlapping pieces are one, so that no tail stays
                    last = max(last, s["end"])
                    continue
                done += [text[last : s["start"]], f"[{s['kind'].upper()}]"]
                last = s["end"]
            out.append("".join([*done, text[last:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["request_id", "place", "masked"])


def masked(requests: DataFrame, results: DataFrame, person_names: DataFrame) -> DataFrame:
    """(request_id, place, masked): every value with its pieces replaced by [EMAIL], [PHONE] and so on.

    The rest of a value stays as it is. Null and empty values are left out; repeated rows of a request and place
    with the same text come out once.
    """
    spans = detected(requests, results, person_names).distinct().groupBy("request_id", "place", "th").agg(F.collect_list(F.struct("kind", "start", "end")).alias("spans"))
    values = values_of(requests, results).dropDuplicates(["request_id", "place", "th"])
    return values.join(spans, ["request_id", "place", "th"], "left").select("request_id", "place", "text", "spans").mapInArrow(_replace, "request_id long, place string, masked string")
