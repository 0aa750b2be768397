"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon turns each word into a class: insult, harm, intent, person, negation, report and so on. Insult words and stems
are learned from labelled documents; the other classes are fixed lists. Small transducers read the classes of a clause,
each what the one before puts out: `threats` finds announced harm whose object is somebody, `insults` tells epithets from
strings of them and from words that nothing introduces, `directed` whether somebody is addressed, `mentioned`, `negation`
and `reported` what is talked about, denied or somebody else's. These six read from left to right and are composed into
one transducer. What only later words decide is read from right to left: before them `objects` (is a person the object of
a verb, or gets something; has a verb an object), after them `tagged` (a report that follows: "..., they said").
Each pattern found carries the names of its arcs, whose factors multiply; the factors are fixed ones, drawn towards what
the labelled documents show as far as these hold the pattern. A word by itself weighs nothing: a verb of harm counts only
in a threat, an insult only as the pattern that its clause makes of it. A document's evidence is what its patterns weigh,
and a logistic curve turns that into a score."""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.llm.common import documents, fold, others, staged, text_batches, tidied

#: Labelled rows that the lexicon and the curve are fitted on, about (a sample by a hash of the id when there are more).
LABELLED_ROWS = 20_000
#: A word or stem is taken when its spread over toxic and clean documents has at most this chance without a cause.
CHANCE = 1e-7
#: ... and when at least this share of the documents that hold it are toxic.
PURITY = 0.8
STEMS = (4, 5, 6)
#: Of the toxic documents that hold a word or stem, this share must hold no stronger one.
NEW_SHARE = 0.02
#: Log weight below the strongest entry within which an entry is taken without that.
PEER = 1.5
THRESHOLD = 0.7
#: Distinct words whose class a task remembers.
KNOWN_WORDS = 100_000

OTHER, YOU, OBJECT, PERSON, SELF, NEGATION, REPORT, INTENT, HARM, INSULT, MENTION, ARTICLE, INDEFINITE, COPULA, PLACE, COMMA, OPEN, CLOSE, END, RECIPIENT, FATE, THREAT, EPITHET, STRING, BARE = range(25)

# Words of the closed classes, English, German, French, Spanish.
YOUS = "you du tu ihr vosotros usted ustedes"
OBJECTS = "yourself him her them everyone dich dir euch sie te toi vous ellos ellas"
PERSONS = "your yours he she they their people those dein il elle ils elles"
SELVES = "i we ich wir je j'ai nous yo nosotros"
NEGATIONS = "not no never neither nor without isn't aren't don't doesn't nicht kein keine nie niemals ne pas jamais non nunca jamás sin"
REPORTS = "said says say wrote claimed called reported alleged quoted according sagte sagt schrieb nannte dit écrit appelé selon dijo dice escribió llamó según"
INTENTS = "will shall going gonna i'll we'll werde werden wird vais va vont allons voy vas vamos van"
HARMS = "kill murder hurt destroy burn shoot stab strangle beat töten ermorden verletzen vernichten erschießen tuer assassiner détruire frapper brûler matar asesinar destruir golpear quemar"
MENTIONS = "word words term terms phrase slur insult expression wort begriff mot terme palabra término"
ARTICLES = "the this that these such der die das den dem le la les ce cette el los las ese esa"
INDEFINITES = "a an some ein eine einen un une una"
COPULAS = "is are am was were be being 're you're he's she's they're bist ist sind seid es est sont eres son"
PLACES = "in at on with for by until soon forever before after and or but im mit für bis dans avec pour en con por hasta"
CLOSED = ((PLACE, PLACES), (ARTICLE, ARTICLES), (COPULA, COPULAS), (INDEFINITE, INDEFINITES), (MENTION, MENTIONS), (PERSON, PERSONS), (OBJECT, OBJECTS), (YOU, YOUS), (SELF, SELVES), (NEGATION, NEGATIONS), (REPORT, REPORTS), (INTENT, INTENTS), (HARM, HARMS))
#: What the names of a pattern's arcs weigh, as factors on the learned weight of an insult or on a threat's.
FACTORS = {"threat": 1.0, "epithet": 0.6, "string": 1.0, "bare": 0.3, "directed": 1.8, "mentioned": 0.1, "denied": 0.2, "reported": 0.6}
THREAT_WEIGHT = 4.0
#: A factor is drawn towards what the labelled documents show as if it had been seen in so many before.
FACTOR_ROWS = 50
#: Words between the parts of a pattern, at most.
SPAN = 4


# ---- the grammar ---------------------------------------------------------------------------------------------------


@dataclass
class Transducer:
    """Arcs (state, symbol) -> (state, output symbol, names); a missing arc stays, copies its symbol and has no name."""

    start: object
    arcs: dict[tuple[object, object], tuple[object, object, tuple[str, ...]]] = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, ()))

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one puts out is read by the other; names add up."""
        return Composed((self.start, other.start), {}, self, other)

    def run(self, symbols) -> list[tuple[object, tuple[str, ...]]]:
        state, out = self.start, []
        for s in symbols:
            state, put, names = self.step(state, s)
            out.append((put, names))
        return out


@dataclass
class Composed(Transducer):
    """A composition whose arcs are worked out when they are first taken; there are finitely many."""

    first: Transducer | None = None
    second: Transducer | None = None

    def step(self, state, symbol):
        arc = self.arcs.get((state, symbol))
        if arc is None:
            a, mid, names = self.first.step(state[0], symbol)
            b, put, more = self.second.step(state[1], mid)
            arc = self.arcs[state, symbol] = ((a, b), put, names + more)
        return arc


SYMBOLS = range(END + 1)
ADDRESSED = (YOU, OBJECT, PERSON, RECIPIENT, THREAT)
PATTERNS = (EPITHET, STRING, BARE, THREAT)


def objects() -> Transducer:
    """From right to left: a person before an indefinite article gets something ("shoot you an email") and isn't the
    object; a verb of harm without an object is what somebody meets with ("you will burn in ...")."""
    t = Transducer(END)
    for after in SYMBOLS:
        for s in SYMBOLS:
            put = RECIPIENT if after == INDEFINITE and s in (YOU, OBJECT) else FATE if s == HARM and after in (END, COMMA, PLACE, CLOSE) else s
            t.arcs[after, s] = (s, put, ())
    return t


def threats(span: int = SPAN) -> Transducer:
    """Puts out a threat where somebody announces harm to a person: an intent, a verb of harm within `span` words, and
    the person right after it ("I will ... kill you"); an intent, the person, and the verb ("ich werde dich töten"); or
    the person addressed, an intent, and a verb without an object ("you are going to burn"). A verb of harm by itself is
    put out as any other word."""
    none = ("none", 0)
    t = Transducer(none)
    states = [none, ("harm", 1), ("theirs", 1)] + [(kind, n) for kind in ("intent", "object", "you", "fate") for n in range(1, span + 1)]
    for at in states:
        kind, n = at
        less = (kind, n - 1) if n > 1 else none
        for s in (*SYMBOLS, RECIPIENT, FATE):
            t.arcs[at, s] = (less, s, ())
        for s in (HARM, FATE):
            t.arcs[at, s] = (("harm", 1) if kind == "intent" else less, OTHER, ())
        t.arcs[at, INTENT] = (("fate" if kind in ("you", "fate") else "intent", span), INTENT, ())
        t.arcs[at, END] = (none, END, ())
        t.arcs[at, SELF] = (none, SELF, ())
        if kind in ("none", "you", "harm", "theirs"):
            t.arcs[at, YOU] = (("you", span), YOU, ())
        if kind == "intent":
            t.arcs[at, OBJECT] = (("object", span), OBJECT, ())
        if kind == "object":
            t.arcs[at, HARM] = t.arcs[at, FATE] = (none, THREAT, ("threat",))
        if kind == "harm":
            t.arcs[at, YOU] = t.arcs[at, OBJECT] = (none, THREAT, ("threat",))
        if kind == "fate":
            t.arcs[at, FATE] = (none, THREAT, ("threat",))
            t.arcs[at, HARM] = (("theirs", 1), OTHER, ())  # what "you" will do to others is no threat to them
        if kind == "theirs":
            t.arcs[at, YOU] = (none, THREAT, ("threat",))
    return t


def insults(span: int = 2) -> Transducer:
    """An insult within `span` words after another one makes a string of insults; one that begins its clause, or stands
    within `span` words after an article, a form of "to be" or a person, is an epithet; any other is bare."""
    t = Transducer((1, 0))
    for intro in range(span + 1):
        for string_ in range(span + 1):
            at = (intro, string_)
            for s in (*SYMBOLS, RECIPIENT, THREAT):
                opens = s in (ARTICLE, INDEFINITE, COPULA) or s in ADDRESSED
                kept = s in (OPEN, CLOSE)
                t.arcs[at, s] = (at if kept else (span if opens else max(0, intro - 1), max(0, string_ - 1)), s, ())
            put, name = (STRING, "string") if string_ else (EPITHET, "epithet") if intro else (BARE, "bare")
            t.arcs[at, INSULT] = ((max(0, intro - 1), span), put, (name,))
            t.arcs[at, END] = (t.start, END, ())
    return t


def _after(opens: tuple, patterns: tuple, name: str, span: int, spent: bool) -> Transducer:
    """Patterns within `span` words after one of `opens` get a name; the first of them only where that is `spent` on it."""
    t = Transducer(0)
    for n in range(span + 1):
        for s in (*SYMBOLS, RECIPIENT, *PATTERNS):
            t.arcs[n, s] = (n if s in (OPEN, CLOSE) else max(0, n - 1), s, ())
        for s in patterns:
            t.arcs[n, s] = (0 if spent else n, s, (name,) if n else ())
        for s in opens:
            t.arcs[n, s] = (span, s, ())
        t.arcs[n, END] = (0, END, ())
    return t


def directed(span: int = SPAN) -> Transducer:
    """An insult within `span` words after a person is aimed at somebody."""
    return _after(ADDRESSED, (EPITHET, STRING, BARE), "directed", span, False)


def mentioned(span: int = 2) -> Transducer:
    """An insult within `span` words after "the word", "a slur" or the like is only talked about."""
    t = _after((), (EPITHET, STRING, BARE), "mentioned", span, True)
    for s in (*SYMBOLS, RECIPIENT, *PATTERNS):
        t.arcs["article", s] = (0, s, ())
    t.arcs["article", MENTION] = (span, MENTION, ())
    for at in ("article", *range(span + 1)):
        for s in (ARTICLE, INDEFINITE):
            t.arcs[at, s] = ("article" if at in ("article", 0) else at, s, ())
    return t


def negation(span: int = SPAN) -> Transducer:
    """An insult or threat within `span` words after a negation is denied."""
    return _after((NEGATION,), PATTERNS, "denied", span, True)


def reported() -> Transducer:
    """What follows a word of reporting in its clause, unless the speaker reports what they said themselves, and what
    stands in quotation marks is somebody else's."""
    t = Transducer("own")
    for s in (*SYMBOLS, RECIPIENT, *PATTERNS):
        t.arcs["self", s] = ("own", s, ())
    t.arcs["own", SELF] = t.arcs["self", SELF] = ("self", SELF, ())
    t.arcs["own", REPORT] = ("theirs", REPORT, ())
    for at in ("own", "self"):
        t.arcs[at, OPEN] = ("quoted", OPEN, ())
    t.arcs["quoted", CLOSE] = ("own", CLOSE, ())
    for at in ("theirs", "quoted"):
        t.arcs[at, END] = ("own", END, ())
        for s in PATTERNS:
            t.arcs[at, s] = (at, s, ("reported",))
    return t


def tagged(span: int = 3) -> Transducer:
    """From right to left: what stands before a comma or closing quotation mark, followed by a report among the last
    words of the clause that isn't the speaker's own ("..., they said"), is somebody else's."""
    t = Transducer(("end", span))
    for kind in ("end", "tag"):
        for n in range(1, span + 1):
            for s in (*SYMBOLS, RECIPIENT, *PATTERNS):
                t.arcs[(kind, n), s] = ((kind, n - 1) if n > 1 else "own", s, ())
            t.arcs[(kind, n), END] = (t.start, END, ())
    for n in range(1, span + 1):
        t.arcs[("end", n), REPORT] = (("tag", span), REPORT, ())
        t.arcs[("tag", n), SELF] = ("own", SELF, ())
        for s in (COMMA, CLOSE):
            t.arcs[("end", n), s] = (("end", n), s, ())
            t.arcs[("tag", n), s] = ("theirs", s, ())
    for s in PATTERNS:
        t.arcs["theirs", s] = ("theirs", s, ("reported",))
    return t


def parts() -> list[Transducer]:
    return [threats(), insults(), directed(), mentioned(), negation(), reported()]


def grammar() -> Transducer:
    machine, *more = parts()
    for part in more:
        machine = machine.then(part)
    return machine


# ---- words ---------------------------------------------------------------------------------------------------------

_TRIM = string.punctuation + "«»“”„‘’…–—¿¡"
_STOPS = (".", "!", "?", ";", ":")
_QUOTES = "\"«»“”„"


def features(word: str) -> list[str]:
    """The whole word and its stems, as the lexicon knows them."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def words_of(text: str) -> set[str]:
    return {w for x in set(text.lower().split()) if (w := x.strip(_TRIM)) and not w.isdigit()}


def chance_log(n1: int, n0: int, share: float) -> float:
    """A bound on the log of the chance that n1 of n1 + n0 documents are toxic when each is with `share`."""
    n, p = n1 + n0, n1 / (n1 + n0)
    if p <= share:
        return 0.0
    low = n0 * math.log((1 - p) / (1 - share)) if n0 else 0.0
    return -(n1 * math.log(p / share) + low)


@dataclass
class Model:
    lexicon: dict[str, float]
    curve: tuple[float, float]
    factors: dict[str, float] = field(default_factory=lambda: dict(FACTORS))

    def __post_init__(self):
        self.before, self.machine, self.after = objects(), grammar(), tagged()
        self.closed = {}
        for symbol, listed in CLOSED:
            self.closed.update(dict.fromkeys(listed.split(), symbol))
        self.known: dict[str, int] = {}
        self.weights: dict[str, float] = {}

    def __getstate__(self):
        return {"lexicon": self.lexicon, "curve": self.curve, "factors": self.factors}

    def __setstate__(self, state):
        self.__init__(**state)

    def symbol(self, token: str) -> int:
        word = token.strip(_TRIM)
        weight = max((self.lexicon.get(f, 0.0) for f in features(word)), default=0.0) if word else 0.0
        if weight:
            self.weights[token] = weight
            return INSULT
        return self.closed.get(word, OTHER)

    def patterns(self, text: str) -> Iterator[tuple[frozenset[str], float]]:
        """The names and the lexical weight of each pattern in a text's clauses."""
        tokens = text.lower().split()
        classes = list(map(self.known.get, tokens))
        if None in classes:
            for token in {t for t, c in zip(tokens, classes) if c is None}:
                self.known[token] = self.symbol(token)
            classes = list(map(self.known.__getitem__, tokens))
        done = -1
        if INSULT in classes or HARM in classes:
            for i, c in enumerate(classes):
                if c != INSULT and c != HARM or i <= done:
                    continue
                begin = i
                while begin > done + 1 and not tokens[begin - 1].endswith(_STOPS):
                    begin -= 1
                done = i
                while done + 1 < len(tokens) and not tokens[done].endswith(_STOPS):
                    done += 1
                yield from self.clause(tokens[begin : done + 1], classes[begin : done + 1])
        while len(self.known) > KNOWN_WORDS:
            self.weights.pop(self.known.popitem()[0], None)

    def clause(self, tokens: list[str], classes: list[int]) -> Iterator[tuple[frozenset[str], float]]:
        symbols, of = [], []
        for token, c in zip(tokens, classes):
            marks = token.rstrip(".,!?;:")
            each = [OPEN] if token[0] in _QUOTES else []
            each += [] if not token.strip(_TRIM) else [c]
            each += [CLOSE] if len(marks) > 1 and marks[-1] in _QUOTES else []
            each += [COMMA] if "," in token[-2:] else []
            symbols += each
            of += [token] * len(each)
        read = self.before.run([END, *reversed(symbols)])
        found = self.machine.run([s for s, _ in reversed(read)])
        last = self.after.run([s for s, _ in reversed(found)])
        for (put, names), (_, more), token in zip(found, reversed(last), of):
            if put in PATTERNS:
                yield frozenset(names + more), THREAT_WEIGHT if put == THREAT else self.weights[token]

    def evidence(self, text: str) -> float:
        """What the patterns of a text weigh together."""
        return sum(weight * math.prod(self.factors[n] for n in sorted(names)) for names, weight in self.patterns(text))

    def score(self, text: str) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(self.evidence(text))))))


# ---- learning ------------------------------------------------------------------------------------------------------


def _count(wanted: set[str] | None):
    """Documents that hold each word or stem: of toxic ones all, or of clean ones those wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                each = {f for w in words_of(text.as_py()) for f in features(w)}
                found.update(each if wanted is None else each & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["feature", "n"])

    return tidied(run)


def _held(wanted: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({f for w in words_of(t.as_py()) for f in features(w)} & wanted) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["features"])

    return tidied(run)


def explaining(lexicon: dict[str, float], held: list[list[str]]) -> dict[str, float]:
    """The entries, strongest first, that some toxic documents without a stronger one hold, or that are about as
    strong as the strongest. Near copies of one toxic
    document share many harmless words, but the documents that hold those have a stronger entry already."""
    at: dict[str, list[int]] = {}
    for i, row in enumerate(held):
        for f in row:
            at.setdefault(f, []).append(i)
    open_, out = [True] * len(held), {}
    for f, weight in sorted(lexicon.items(), key=lambda x: (-x[1], len(x[0]), x[0])):
        rows = at.get(f, [])
        peer = bool(out) and weight >= next(iter(out.values())) - PEER and not any(f.startswith(g.rstrip("*")) for g in out)
        if peer or sum(open_[i] for i in rows) >= max(3, math.ceil(NEW_SHARE * len(rows))):
            out[f] = weight
            for i in rows:
                open_[i] = False
    return out


def _weigh(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [model.evidence(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), batch.column("toxic")], ["evidence", "toxic"])

    return tidied(run)


def _named(model: Model):
    """The names of the patterns that each text holds, and "any" if there are some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set().union(*(names for names, _ in model.patterns(t.as_py()))) for t in batch.column("text")]
            found = [sorted(names | {"any"}) if names else [] for names in found]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column("toxic")], ["names", "toxic"])

    return tidied(run)


def fit_factors(held: dict[str, tuple[int, int]], n1: int, n0: int) -> dict[str, float]:
    """FACTORS, drawn towards what documents show: of n1 toxic and n0 clean ones, `held` says how many hold each name of
    a pattern, and any pattern. What a name shows is its log odds, above those of all documents, as a share of any
    pattern's (0 to 2); it counts as the number of documents that hold it, the fixed factor as FACTOR_ROWS."""

    def odds(name: str) -> float:
        k1, k0 = held.get(name, (0, 0))
        return math.log((k1 + 0.5) / (n1 + 1)) - math.log((k0 + 0.5) / (n0 + 1))

    out, whole = dict(FACTORS), odds("any")
    for name, fixed in FACTORS.items() if whole > 0 else ():
        n = sum(held.get(name, (0, 0)))
        out[name] = (FACTOR_ROWS * fixed + n * min(2.0, max(0.0, odds(name) / whole))) / (FACTOR_ROWS + n)
    return out


def fit_curve(evidence: np.ndarray, toxic: np.ndarray, ridge: float = 0.05, steps: int = 30) -> tuple[float, float]:
    """A ridge logistic curve on log1p(evidence), by Newton's steps."""
    x = np.column_stack([np.ones(len(evidence)), np.log1p(evidence)])
    beta, penalty = np.zeros(2), np.diag([1e-6, ridge])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + penalty
        beta = beta + np.linalg.solve(hess, x.T @ (toxic - p) - penalty @ beta)
    return float(beta[0]), float(max(beta[1], 0.0))


def learn(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """A model from labelled documents outside the held-out fold. Rows with a null id, text or label are left out; an
    id with two labels or texts counts with each; equal texts count once, as toxic if any row of theirs is. Very long
    texts are read whole. Without toxic or clean rows, as for empty tables, the lexicon is empty. Other columns play no part."""
    spark = docs.sparkSession
    text_batches(spark)
    usable = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(fold(F.col("doc_id"), 3) != 1).distinct()
    share = min(1.0, rows / max(1, usable.count()))
    # the sample has about `rows` ids and two small columns whatever the corpus, so it may be broadcast
    sample = usable.filter(F.shiftright(F.xxhash64("doc_id", F.lit(11)), 32) < (2**32 * share) - 2**31)
    train = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(sample), "doc_id")
    train = train.groupBy(F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    train = staged(train.select("text", "toxic"), "toxic-train")
    sizes = {bool(r["toxic"]): r["count"] for r in train.groupBy(F.col("toxic") > 0).count().toDF("toxic", "count").collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return Model({}, (-2.0, 0.0))
    prior = n1 / (n1 + n0)
    least = max(2, math.ceil(math.log(CHANCE) / math.log(prior)))
    schema = "feature string, n long"
    toxic = train.filter("toxic > 0").select("text").mapInArrow(_count(None), schema)
    # a sample's features, each in `least` documents or more: bounded by the sample
    toxic = {r[0]: r[1] for r in toxic.groupBy("feature").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()}
    clean = train.filter("toxic <= 0").select("text").mapInArrow(_count(set(toxic)), schema)
    clean = {r[0]: r[1] for r in clean.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    lexicon = {}
    for f, k1 in toxic.items():
        k0 = clean.get(f, 0)
        if k1 / (k1 + k0) >= PURITY and chance_log(k1, k0, prior) <= math.log(CHANCE):
            lexicon[f] = math.log((k1 + 0.5) / (n1 + 1)) - math.log((k0 + 0.5) / (n0 + 1))
    held = train.filter("toxic > 0").select("text").mapInArrow(_held(set(lexicon)), "features array<string>")
    lexicon = explaining(lexicon, [r[0] for r in held.collect()])
    names = train.mapInArrow(_named(Model(lexicon, (0.0, 1.0))), "names array<string>, toxic int").select(F.explode("names").alias("name"), (F.col("toxic") > 0).cast("int").alias("bad"))
    # a row for each name at most
    held = names.groupBy("name").agg(F.sum("bad").alias("k1"), F.sum(1 - F.col("bad")).alias("k0")).collect()
    factors = fit_factors({r["name"]: (r["k1"], r["k0"]) for r in held}, n1, n0)
    model = Model(lexicon, (0.0, 1.0), factors)
    found = train.mapInArrow(_weigh(model), "evidence double, toxic int").toPandas()
    return Model(lexicon, fit_curve(found["evidence"].to_numpy(), (found["toxic"] > 0).to_numpy(float)), factors)


# ---- scoring -------------------------------------------------------------------------------------------------------


def score_udf(model: Model):
    import pandas as pd

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([model.score(t or "") for t in part], dtype="float64")

    score = tidied(score)
    score.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted (columns of those names are replaced, all others kept). A null text counts as empty,
    and an empty one scores as one without a match. Repeated rows score alike; very long texts count whole; an empty
    table gives an empty table."""
    keep = others(docs, ("score", "predicted"))
    text_batches(docs.sparkSession)

    scored = docs.select(*keep, score_udf(model)(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op5_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = (fold(F.col("doc_id"), 3) == 1).alias("held_out")
    return score_documents(docs.select("doc_id", "text"), model).select("doc_id", held, "score", "predicted")
