"""Personal data by weak supervision: labelers vote on spans, their reliabilities are estimated, a classifier is trained.

Base spans (email, ip, card, phone) are patterns with a test each and always stand.  Beyond them a broad pattern per kind
proposes candidates (names of persons, identity and telephone numbers without a plus, bank accounts, spelled-out addresses).
What is seen at a candidate is a set of signals: its shape, words of a gazetteer in it, cue words of several
languages before it, base spans near it.  A labeler reads signals and votes for, against or not at all:
regex labelers by shape or checksum, gazetteer labelers by word lists, context labelers by the words around.

The corpus is one table of counts by (kind, signals), at most ``2 ** BITS`` rows a kind, summed over all
candidates; only that comes to the driver.  Expectation-maximisation over its votes estimates how often each
labeler votes how on true and on false candidates, with a prior that a labeler is rather right; the
posteriors are soft labels for a logistic regression on all signals, those of no labeler included.  A candidate is a span if the
classifier gives it ``THRESHOLD`` and at least one labeler votes for it.

Texts are read once, by tasks that keep spans and signals, and again only to mask them.

Defined results: null text is empty; places are code points, end exclusive; matches of a kind are leftmost and do
not overlap, and one that fails its test is dropped without another try; a candidate that touches a base span is
none; spans of different kinds may overlap; a repeated row gets the same spans again; every pattern takes time in
proportion to the text, so a very long one is only longer; without candidates nothing but base spans is found; an
empty table gives no rows.  Other columns are not read and may have any name.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.llm.common import slices, stage

THRESHOLD = 0.8
#: Pseudo-candidates of the prior for each candidate, and the share of them that is true.
PRIOR_WEIGHT, PRIOR_TRUE = 0.05, 0.1
#: How a labeler votes on true candidates a priori: not at all, for, against; on false ones the last two change places.
PRIOR_VOTES = (0.5, 0.45, 0.05)
ROUNDS, RIDGE = 200, 1e-3
#: Characters before a candidate in which cue words are looked for, and around it for base spans.
CUE_CHARS, NEAR_CHARS = 40, 80
BITS = 8

BASE = ("email", "ip", "card", "phone")

# Word lists and forms as they occur in texts.
GIVEN = frozenset(
    """Alice Anna Antonio Barbara Carlos Carmen Charles Christine Claire Daniel David Elena Elizabeth Emma Erik Francisco
    Frank François Hans Isabel Jack James Jane Jean Jennifer John José Juan Julia Jürgen Karl Katharina Laura Linda Lucía
    Luis Manuel Maria María Marie Marta Martin Mary Michael Michel Miguel Monika Nicole Olivier Patricia Paul Pedro Peter
    Philippe Pierre Rafael Richard Robert Sabine Sarah Sophie Stefan Susan Thomas Ursula William Wolfgang""".split()
)
FUNCTION_WORDS = frozenset(
    """the of for and in on at to by with from this that is are was be as an it der die das und ist den dem des ein eine von
    mit auf für zu im nicht le la les un une des du et est que qui dans pour pas el los las una y en es por con para""".split()
)
TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra?)\.? ?$"
NAME_CUES = r"(?i:name is|named|signed|regards|sincerely|name ist|heißt?|m'appelle|nom|llamo|nombre)\b[ ,:\n]*$"
ID_CUES = r"(?i:\bssn|social security|passport|\bdni\b|\bnie\b|ausweis|steuer-?id|sécurité sociale|seguridad social)"
PHONE_CUES = r"(?i:\btel\b|\btel\.|phone|\bcall\b|\bfax\b|mobile|\bhandy\b|móvil|telefon|téléphone|teléfono)"
OTHER_NUMBER_CUES = r"(?i:isbn|order|invoice|version|\bpages?\b|price|\bno\.|\bnr\.|[$€£#])"
ACCOUNT_CUES = r"(?i:\biban\b|account|\bkonto|compte|cuenta|\bbank)"
CONTACT_CUES = r"(?i:e-?mail|contact|write to|reach|courriel|correo|schreib)"
DOMAINS = frozenset("com org net edu gov info io de fr es uk eu ch at it nl us".split())
COUNTRIES = frozenset(
    """AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR""".split()
)

_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From at sign to at sign: a match begins where the run of local characters before it does."""
    free, at = 0, text.find("@")
    while at >= 0:
        start, m = at, _DOMAIN.match(text, at + 1)
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if m and start < at:
            free = after = m.end()
            yield start, free
        at = text.find("@", after)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in order."""
    found = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part) <= 3 and int(part) <= 255 for part in (p.lstrip("0") or "0" for p in m.group().split("."))):
                found.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((3, *m.span()))
    return found


class Labeler(NamedTuple):
    name: str
    #: Signals, any of which make it vote for or against.
    votes_for: tuple[int, ...] = ()
    votes_against: tuple[int, ...] = ()


class Kind(NamedTuple):
    name: str
    pattern: re.Pattern
    #: What must be in a text for the pattern to be tried.
    needs: Callable[[str], object]
    #: (match, text before it) to what is seen, by number; the last signal, a base span near, is added for all.
    signals: Callable[[re.Match, str], tuple[bool, ...]]
    labelers: tuple[Labeler, ...]


NEAR = BITS - 1


def _person(m: re.Match, before: str) -> tuple[bool, ...]:
    words = m.group().split()
    return (
        words[0] in GIVEN,
        bool(re.search(TITLES, before)),
        bool(re.search(NAME_CUES, before)),
        any(w.lower() in FUNCTION_WORDS for w in words),
        len(set(words)) < len(words),
        not before.rstrip() or before.rstrip()[-1] in ".!?:\n" or before.endswith("\n"),
        len(words) > 2,
    )


def _number(m: re.Match, before: str) -> tuple[bool, ...]:
    whole, groups = m.group(), re.findall(r"[0-9]+", m.group())
    social = bool(re.fullmatch(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", whole))
    local = bool(re.fullmatch(r"\([0-9]{3}\) ?[0-9]{3}[ -][0-9]{4}|0[0-9]{1,4}[ /-][0-9 -]{5,}[0-9]", whole))
    date = bool(re.fullmatch(r"(?:[0-9]{4}[-. /][0-9]{2}[-. /][0-9]{2}|[0-9]{2}[-. /][0-9]{2}[-. /](?:19|20)[0-9]{2})", whole))
    return (
        social,
        local,
        bool(re.search(ID_CUES, before)),
        bool(re.search(PHONE_CUES, before)),
        date,
        bool(re.search(OTHER_NUMBER_CUES, before[-12:])),
        len(set("".join(groups))) < 3 or not 7 <= sum(map(len, groups)) <= 12,
    )


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _account(m: re.Match, before: str) -> tuple[bool, ...]:
    code = m.group().replace(" ", "")
    right, known = 15 <= len(code) <= 34 and mod97(code), code[:2] in COUNTRIES
    return right, not right, known, not known, bool(re.search(ACCOUNT_CUES, before)), len(code) < 15, False


def _contact(m: re.Match, before: str) -> tuple[bool, ...]:
    whole = m.group().lower()
    return (
        bool(re.search(r"[\[(]at[\])]", whole)),
        bool(re.search(r"[\[(]dot[\])]", whole)),
        re.split(r"[^a-z]+", whole)[-1] in DOMAINS,
        bool(re.search(CONTACT_CUES, before)),
        m.group(1).lower() in FUNCTION_WORDS,
        bool(re.search(r"[0-9._]", m.group(1))),
        False,
    )


_AT = r"(?: ?\[at\] ?| ?\(at\) ?| at )"
_DOT = r"(?: ?\[dot\] ?| ?\(dot\) ?| dot )"
KINDS = (
    Kind(
        "person", re.compile(r"(?<!\w)[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++(?: [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++){1,2}(?!\w)"), bool, _person,
        (Labeler("given names", (0,)), Labeler("titles", (1,)), Labeler("name cues", (2,)), Labeler("function words", (), (3,)),
         Labeler("repetition", (), (4,)), Labeler("sentence start", (), (5,))),
    ),
    Kind(
        "number", re.compile(r"(?<![\w.,+/-])(?:\([0-9]{3}\) ?[0-9]{3}[ -][0-9]{4}|[0-9]{2,5}(?:[ ./-][0-9]{2,4}){1,4})(?![\w/-]|[.,][0-9])"), _DIGIT.search, _number,
        (Labeler("social security form", (0,)), Labeler("telephone form", (1,)), Labeler("identity cues", (2,)),
         Labeler("telephone cues", (3,)), Labeler("date form", (), (4,)), Labeler("other cues", (), (5,)), Labeler("dull digits", (), (6,))),
    ),
    Kind(
        "account", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), _DIGIT.search, _account,
        (Labeler("checksum", (0,), (1,)), Labeler("countries", (2,), (3,)), Labeler("account cues", (4,)), Labeler("length", (), (5,))),
    ),
    Kind(
        "contact", re.compile(rf"(?<![\w.+-])([A-Za-z0-9][\w.+-]*+){_AT}[A-Za-z0-9][\w-]*+(?:{_DOT}[A-Za-z0-9-]{{2,}}+)+(?!\w)"),
        lambda text: "dot" in text, _contact,
        (Labeler("brackets", (0, 1)), Labeler("domains", (2,)), Labeler("contact cues", (3,)), Labeler("function words", (), (4,))),
    ),
)
#: Names of all kinds by number, base ones first.
NAMES = BASE + tuple(k.name for k in KINDS)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, signals), kinds counted on from the base ones."""
    found = []
    starts, ends = (sorted(s[i] for s in base) for i in (1, 2))
    for number, kind in enumerate(KINDS, len(BASE)):
        if not kind.needs(text):
            continue
        for m in kind.pattern.finditer(text):
            a, b = m.span()
            # Base spans that end after a, less those that start at or after b, touch it.
            if bisect_left(starts, b) > bisect_right(ends, a):
                continue
            near = bisect_left(starts, b + NEAR_CHARS) > bisect_right(ends, a - NEAR_CHARS)
            seen = (*kind.signals(m, text[max(a - CUE_CHARS, 0) : a]), near)
            found.append((number, a, b, sum(1 << i for i, s in enumerate(seen) if s)))
    return found


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_SEEN = pa.struct([*_SPAN, pa.field("signals", pa.int32())])
_SHAPE = (
    "spans array<struct<kind:int,start:bigint,end:bigint>>, "
    "candidates array<struct<kind:int,start:bigint,end:bigint,signals:int>>"
)


def _lists(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    flat = [s for row in rows for s in row]
    columns = [pa.array([s[i] for s in flat], f.type) for i, f in enumerate(kind)]
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(kind)))


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in slices(batch.column(1)):
            part = batch.slice(start, stop - start)
            texts = [t or "" for t in part.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            seen = [candidates(t, b) for t, b in zip(texts, base, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(base, _SPAN), _lists(seen, _SEEN)], ["id", "spans", "candidates"])


def tagged(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table without texts: id, base spans, candidates with their signals."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return stage(rows.mapInArrow(_tagged, f"id {kind}, {_SHAPE}"), "personal")


def votes(kind: Kind, signals: np.ndarray) -> np.ndarray:
    """Per row and labeler: 0 no vote, 1 for, 2 against."""
    def any_of(numbers: tuple[int, ...]) -> np.ndarray:
        return (signals & sum(1 << i for i in numbers)) > 0

    columns = [np.where(any_of(lab.votes_for), 1, np.where(any_of(lab.votes_against), 2, 0)) for lab in kind.labelers]
    return np.stack(columns, axis=1)


def reliabilities(cast: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows of votes and how often each occurs to (share of true ones, table, posterior of each row).

    ``table[j, z, v]`` is how often labeler ``j`` votes ``v`` on candidates that are (``z = 1``) or are not true.
    A vote for is never likelier on false candidates than on true ones, nor a vote against on true than on false.
    """
    of_true = np.array(PRIOR_VOTES)
    prior = np.stack((of_true[[0, 2, 1]], of_true))
    weight = PRIOR_WEIGHT * n.sum()
    is_vote = cast[:, :, None] == np.arange(3)
    q = 1 / (1 + np.exp(1 - 1.5 * ((cast == 1).sum(1) - (cast == 2).sum(1))))
    for _ in range(ROUNDS):
        share = (n @ q + weight * PRIOR_TRUE) / (n.sum() + weight)
        by_class = np.stack((n * (1 - q), n * q))
        table = np.einsum("zr,rjv->jzv", by_class, is_vote) + weight * prior
        table /= table.sum(axis=2, keepdims=True)
        for v, right in ((1, 1), (2, 0)):
            wrong = table[:, right, v] < table[:, 1 - right, v]
            table[wrong, :, v] = table[wrong][:, :, v].mean(axis=1, keepdims=True)
        table /= table.sum(axis=2, keepdims=True)
        logs = np.log(table)
        odds = np.log(share / (1 - share)) + (is_vote * (logs[:, 1] - logs[:, 0])).sum(axis=(1, 2))
        new = 1 / (1 + np.exp(-odds))
        if np.abs(new - q).max(initial=0) < 1e-10:
            break
        q = new
    return float(share), table, q


def regression(signals: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on the signals, the constant last, from soft labels ``q`` with counts ``n``."""
    x = np.column_stack(((signals[:, None] >> np.arange(BITS)) & 1, np.ones(len(signals)))).astype(float)
    w, share = np.zeros(BITS + 1), n / n.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - q)) + RIDGE * w
        step = np.linalg.solve((x * (share * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + RIDGE * np.eye(BITS + 1), gradient)
        w = w - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-12:
            break
    return w


class Model(NamedTuple):
    #: By kind, from the first that is no base kind; zeros where no candidate was seen.
    weights: np.ndarray
    shares: list[float | None]
    tables: list[np.ndarray | None]

    def accepts(self, kind: int, signals: int) -> bool:
        w, own = self.weights[kind - len(BASE)], KINDS[kind - len(BASE)]
        z = w[-1] + sum(w[i] for i in range(BITS) if signals >> i & 1)
        return bool(z >= np.log(THRESHOLD / (1 - THRESHOLD)) and (votes(own, np.array([signals])) == 1).any())


def learn(table: DataFrame) -> Model:
    """From all candidates of a tagged table."""
    each = table.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.signals").agg(F.count(F.lit(1)).alias("n"))
    rows = sorted((r.kind, r.signals, r.n) for r in each.collect())
    weights, shares, tables = np.zeros((len(KINDS), BITS + 1)), [None] * len(KINDS), [None] * len(KINDS)
    for i, kind in enumerate(KINDS):
        own = [(s, n) for k, s, n in rows if k == i + len(BASE)]
        if own:
            signals, n = np.array([s for s, _ in own]), np.array([n for _, n in own], float)
            shares[i], tables[i], q = reliabilities(votes(kind, signals), n)
            weights[i] = regression(signals, n, q)
    return Model(weights, shares, tables)


def accepted(model: Model) -> Column:
    """Spans among the column ``candidates``, and the base ones, by kind and place."""
    yes = [k << BITS | s for k in range(len(BASE), len(NAMES)) for s in range(1 << BITS) if model.accepts(k, s)]
    code = lambda c: F.shiftleft(c["kind"], BITS).bitwiseOR(c["signals"])
    taken = F.filter("candidates", lambda c: F.array_contains(F.lit(yes).cast("array<int>"), code(c)))
    plain = F.transform(taken, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return F.array_sort(F.concat("spans", plain))


def spans_text(spans: Column) -> Column:
    names = F.array(*(F.lit(n) for n in NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and spans (kind, start, end) by kind and place; the model is learned from ``docs``."""
    table = tagged(docs, id, text)
    return table.select(F.col("id").alias(id), accepted(learn(table)).alias("spans"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first one."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{NAMES[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text with its spans masked; null stays null), by a model learned before, on this or another corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part, out = batch.slice(start, stop - start), []
                for t in part.column(1).to_pylist():
                    base = base_spans(t or "")
                    more = [c[:3] for c in candidates(t or "", base) if model.accepts(c[0], c[3])]
                    out.append(None if t is None else masked(t, base + more))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["id", "text"])

    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").toDF(id, text)
