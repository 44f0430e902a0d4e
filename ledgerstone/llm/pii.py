"""Personal data by weak supervision, with DataFrame functions only.

Candidates are the matches of regexes, some strict (the base kinds, which always stay) and some loose. Labelers vote on each:
its form, gazetteers (the domains, networks, issuers and area codes that base matches all over the table share, and well-known
values that belong to nobody), the words before it, the characters around it, and whether the text holds base data of another
kind. Votes are counted by pattern; expectation-maximisation over these counts estimates for each kind how reliable each labeler
is (with the labeler's mean over kinds as prior) and how often the kind is real. Its posteriors are the soft labels of the final
classifier, a naive Bayes over the votes, the span's length and its share of digits. Loose candidates that it accepts become spans.

Only counted patterns and gazetteers come to the driver; the number of patterns depends on the kinds, labelers and bins, and a
gazetteer holds KNOWN keys of a kind at most, those with most matches (ties: the first by name), each with LEAST or more.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce
from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, span_digest, whole, written

_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
LOCAL = "A-Za-z0-9._%+-"


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[ -]", ""))

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.length(digits).between(13, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits))), F.lit(0), add) % 10 == 0)


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


#: kind: (what a text needs, regex, check of a match). The regexes match what the contract's do, but try only the places where
#: a match can begin (the start of a run, or where the last match ended) and never step back, so that long runs take linear time.
BASE = {
    "email": (lambda t: F.contains(t, F.lit("@")), rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda v: F.lit(True)),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda v: v.rlike(rf"^{_PART}(\.{_PART}){{3}}$")),
    "card": (lambda t: t.rlike("[0-9]"), r"[0-9](?:[ -]?[0-9])++", _luhn),
    "phone": (lambda t: F.contains(t, F.lit("+")), r"\+[0-9][ ().0-9-]+[0-9]", lambda v: _digits(v).between(9, 15)),
}
# Common given names and titles, cue words, and values that are nobody's.
GIVEN = "James|Mary|Robert|Patricia|John|Jennifer|Michael|Linda|David|Elizabeth|William|Barbara|Richard|Susan|Joseph|Jessica|Thomas|Sarah|Charles|Karen|Maria|Anna|Peter|Paul|Julia|Laura|Hans|Klaus|Ursula|Pierre|Marie|Jean|Claire|Carlos|Carmen|Juan|Lucia"
CUES = {
    "email": "mail|contact|write|correo|kontakt|courriel", "ip": "ip|address|server|host|adresse", "card": "card|visa|credit|karte|carte|tarjeta", "phone": "phone|call|tel|mobile|fax|contact",
    "local_phone": "phone|call|tel|mobile|fax|contact", "account": "account|card|iban|konto|compte|cuenta|number", "national_id": "ssn|social security|national id|tax id", "name": "mr|mrs|ms|dr|prof|name|dear|herr|frau|signed",
}
AGAINST = "version|isbn|order|figure|section|build|page|chapter|table|invoice|release"
NOBODY = r"^(127\.|0\.|255\.)|@example\.|^0{3}|^(.)\1+$|^(123|987)"
LOOSE = {
    "local_phone": (lambda t: t.rlike("[0-9]{3}[.-][0-9]{4}"), r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9-])", lambda v: F.lit(True)),
    "account": (lambda t: t.rlike("[0-9]{9}"), r"(?<![0-9.+-])[0-9]{9,19}(?![0-9.-])", lambda v: F.lit(True)),
    "national_id": (lambda t: t.rlike("-[0-9]{2}-"), r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda v: F.lit(True)),
    "name": (lambda t: t.rlike(rf"\b(?:{GIVEN}) [A-Z]"), rf"\b(?:{GIVEN}) [A-Z][a-z]+(?![A-Za-z])", lambda v: F.lit(True)),
}
KINDS = BASE | LOOSE
LABELERS = ("form", "gazetteer", "context", "border", "company")
CANDIDATE = "struct<kind:string,start:long,end:long,votes:array<int>,length:int,digits:int,key:string>"
#: Of a value, what a gazetteer knows it by (the first group); loose kinds share the gazetteer of the base kind that they are like.
KEYS = {"email": r"@(.+)$", "ip": r"^([0-9]+\.[0-9]+)", "card": "^([0-9]{4})", "phone": r"^\+[0-9]{1,3}[ (.-]+([0-9]{3})", "local_phone": r"^\(?([0-9]{3})", "account": "^([0-9]{4})"}
LIKE = {"local_phone": "phone", "account": "card"}
#: Parameters: keys of a gazetteer at most, matches of a key at least, pseudo-votes of a labeler's mean over the kinds.
KNOWN, LEAST, TOWARDS_MEAN = 200, 3, 10.0
_CHUNK = 256


def _votes(kind: str, value: Column, before: Column, after: Column) -> Column:
    """1 for, -1 against, 0 abstains; in the order of LABELERS. The gazetteers' votes for, and company's, come in voted()."""
    form = F.lit(1) if kind in BASE else F.when(value.rlike(r"^\(?[01]"), -1).otherwise(0)  # a loose form alone says nothing
    gazetteer = F.when(value.rlike(NOBODY), -1).when(F.lit(kind == "name"), 1).otherwise(0)  # the pattern of names is a gazetteer
    context = F.when(before.rlike(rf"(?i)\b({CUES[kind]})"), 1).when(before.rlike(rf"(?i)\b({AGAINST})"), -1).otherwise(0)
    border = F.when(before.rlike(r"[A-Za-z0-9_]$") | after.rlike(r"^[A-Za-z0-9_]"), -1).otherwise(F.when((before == "") | (after == ""), 0).otherwise(1))
    return F.array(form, gazetteer, context, border, F.lit(0))


def _candidates(text: Column, kind: str) -> Column:
    """The checked matches of a kind with their places, from the matches and the gaps between them.

    Places are running sums: over chunks of matches first, then within each chunk, so that a text of many matches takes linear
    time but for the chunks' own sums.
    """
    needs, pattern, check = KINDS[kind]
    held = F.when(needs(text), text)  # null: no match is looked for
    parts = F.struct(F.regexp_extract_all(held, F.lit(pattern), F.lit(0)).alias("found"), F.split(held, pattern, -1).alias("gaps"))

    def placed(p: Column) -> Column:
        found, gaps = p["found"], p["gaps"]
        n = F.size(found)
        chunks = F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int"))
        numbers = lambda c: F.sequence(c * _CHUNK, F.least(n, (c + 1) * _CHUNK) - 1)
        size = lambda i: F.char_length(F.get(gaps, i)).cast("long") + F.char_length(F.get(found, i))
        total = lambda c: F.aggregate(numbers(c), F.lit(0).cast("long"), lambda acc, i: acc + size(i))
        starts = F.aggregate(chunks, F.array(F.lit(0).cast("long")), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + total(c))))

        def step(acc: Column, i: Column) -> Column:
            value, start = F.get(found, i), acc["at"] + F.char_length(F.get(gaps, i))
            before, after = F.right(F.get(gaps, i), F.lit(40)), F.left(F.get(gaps, i + 1), F.lit(20))
            own = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(value)).alias("end"), _votes(kind, value, before, after).alias("votes"), F.least(F.lit(5), F.floor(F.char_length(value) / 6)).cast("int").alias("length"), F.floor(_digits(value) * 4 / F.char_length(value)).cast("int").alias("digits"), (F.lower(F.regexp_extract(value, KEYS[kind], 1)) if kind in KEYS else F.lit("")).alias("key"))
            return F.struct((acc["at"] + size(i)).alias("at"), F.when(check(value), F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

        def within(st: Column, c: Column) -> Column:
            begin = F.struct(F.get(st, c).alias("at"), F.array().cast(f"array<{CANDIDATE}>").alias("out"))
            return F.aggregate(numbers(c), begin, step, lambda acc: acc["out"])

        return F.get(F.transform(F.array(starts), lambda st: F.flatten(F.transform(chunks, lambda c: within(st, c)))), F.lit(0))

    none = F.array().cast(f"array<{CANDIDATE}>")
    each = F.transform(F.array(parts), lambda p: F.when(F.size(p["found"]) > 0, placed(p)).otherwise(none))  # evaluates parts once
    return F.when(needs(text), F.get(each, F.lit(0))).otherwise(none)


def candidates(df: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
    """df with the array `out` of candidates of every kind, base kinds first; null and empty texts have none."""
    return df.withColumn(out, F.flatten(F.array(*(_candidates(whole(text), k) for k in KINDS))))


def gazetteers(found: DataFrame, column: str = "candidates") -> dict[str, list[str]]:
    """For each base kind the keys that its matches share most, from all rows."""
    c = found.select(F.explode(F.filter(column, lambda c: c["kind"].isin(*BASE) & (c["key"] != "") & (F.get(c["votes"], 1) >= 0))).alias("c"))
    counts = c.groupBy("c.kind", "c.key").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "key"))).where(F.col("rank") <= KNOWN)
    out: dict[str, list[str]] = defaultdict(list)
    for r in top.collect():
        out[r["kind"]].append(r["key"])
    return {k: sorted(v) for k, v in out.items()}


def voted(found: DataFrame, known: dict[str, list[str]], column: str = "candidates") -> DataFrame:
    """found with the gazetteers' votes, and those of the other kinds in the text."""
    kinds = F.array_distinct(F.transform(F.filter(column, lambda c: c["kind"].isin(*BASE)), lambda c: c["kind"]))

    def vote(c: Column) -> Column:
        said = reduce(lambda a, k: a.when(c["kind"] == k, c["key"].isin(known.get(LIKE.get(k, k), []))), KEYS, F.when(F.lit(False), F.lit(False)))
        gazetteer = F.when((F.get(c["votes"], 1) == 0) & said, 1).otherwise(F.get(c["votes"], 1))
        company = F.when(F.exists(kinds, lambda k: (k != c["kind"]) & (k != F.coalesce(*(F.when(c["kind"] == x, F.lit(y)) for x, y in LIKE.items()), F.lit("")))), 1).otherwise(0)
        return c.withField("votes", F.array(F.get(c["votes"], 0), gazetteer, F.get(c["votes"], 2), F.get(c["votes"], 3), company))

    return found.withColumn(column, F.transform(column, vote))


@dataclass(frozen=True)
class Model:
    """reliability: by kind, of each labeler, the probability that a vote is right. real: of each kind. odds: log odds of each feature value."""

    reliability: dict[str, tuple[float, ...]]
    real: dict[str, float]
    odds: dict[str, float]


def train(found: DataFrame, column: str = "candidates", rounds: int = 30) -> Model:
    """Expectation-maximisation over the counted vote patterns of all candidates, then the classifier's tables."""
    c = found.select(F.explode(column).alias("c")).select("c.kind", "c.votes", "c.length", "c.digits")
    rows = [(r["kind"], tuple(r["votes"]), r["length"], r["digits"], r["n"]) for r in c.groupBy("kind", "votes", "length", "digits").agg(F.count("*").alias("n")).orderBy("kind", "votes", "length", "digits").collect()]
    right, real = {k: [0.8] * len(LABELERS) for k in KINDS}, dict.fromkeys(KINDS, 0.5)

    def posterior(kind: str, votes: tuple[int, ...]) -> float:
        score = log(real[kind] / (1 - real[kind])) + sum(v * log(a / (1 - a)) for v, a in zip(votes, right[kind], strict=True))
        return 1 / (1 + exp(-score))

    for _ in range(rounds):
        agree, cast, sums, total = defaultdict(float), defaultdict(float), defaultdict(lambda: 1.0), defaultdict(lambda: 2.0)
        for kind, votes, _, _, n in rows:
            p = posterior(kind, votes)
            sums[kind] += n * p
            total[kind] += n
            for j, v in enumerate(votes):
                if v:
                    agree[kind, j] += n * (p if v > 0 else 1 - p)
                    cast[kind, j] += n
        for j in range(len(LABELERS)):  # priors: votes are right more often than not
            mean = (4 + sum(agree[k, j] for k in KINDS)) / (5 + sum(cast[k, j] for k in KINDS))
            for k in KINDS:
                right[k][j] = min(0.99, max(0.51, (agree[k, j] + TOWARDS_MEAN * mean) / (cast[k, j] + TOWARDS_MEAN)))
        real = {k: min(0.99, max(0.01, sums[k] / total[k])) for k in KINDS}
    yes: dict[str, float] = defaultdict(lambda: 1.0)
    no: dict[str, float] = defaultdict(lambda: 1.0)
    for kind, votes, length, digits, n in rows:
        p = posterior(kind, votes)
        for key in _keys(kind, votes, length, digits):
            yes[key] += n * p
            no[key] += n * (1 - p)
    odds = {}
    for key in yes:
        kind = key.split("|")[0]
        base = log(yes[kind] / no[kind])
        odds[key] = base if key == kind else log(yes[key] / no[key]) - base
    return Model({k: tuple(v) for k, v in right.items()}, real, odds)


def _keys(kind: str, votes: tuple[int, ...], length: int, digits: int) -> list[str]:
    return [kind, *(f"{kind}|{name}|{v}" for name, v in zip(LABELERS, votes, strict=True)), f"{kind}|length|{length}", f"{kind}|digits|{digits}"]


def spans(found: DataFrame, model: Model, column: str = "candidates", out: str = "spans") -> DataFrame:
    """found with the array `out` of kind, start, end, by kind as listed, then start: all base candidates, and the loose ones that
    the classifier accepts and that don't overlap a base one."""
    table = F.create_map(*(x for k, v in sorted(model.odds.items()) for x in (F.lit(k), F.lit(v)))) if model.odds else F.create_map(F.lit(""), F.lit(0.0))

    def score(c: Column) -> Column:
        key = lambda *parts: F.coalesce(F.try_element_at(table, F.concat_ws("|", c["kind"], *parts)), F.lit(0.0))
        votes = (key(F.lit(name), F.get(c["votes"], j).cast("string")) for j, name in enumerate(LABELERS))
        return reduce(lambda a, b: a + b, [key(), *votes, key(F.lit("length"), c["length"].cast("string")), key(F.lit("digits"), c["digits"].cast("string"))])

    base = F.filter(column, lambda c: c["kind"].isin(*BASE))
    free = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    kept = F.filter(column, lambda c: c["kind"].isin(*BASE) | ((score(c) > 0) & free(c)))
    return found.withColumn(out, F.transform(kept, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """df with the array `out` of spans; the model is trained on df's own candidates.

    Null and empty texts have no spans, texts of any length are read whole, repeated rows stay and get equal spans, an empty
    table stays empty. Other columns stay, also one of this name (the new one is then named fresh(df, out)).
    """
    held, out = fresh(df, "candidates"), fresh(df, out)
    marked = written(candidates(df, text, held))
    marked = voted(marked, gazetteers(marked, held), held)
    return spans(marked, train(marked, held), held, out).drop(held)


def pii_digest(documents: DataFrame) -> DataFrame:
    found = written(candidates(documents.select("doc_id", "text")).select("doc_id", "candidates"))
    found = voted(found, gazetteers(found))
    return span_digest(spans(found, train(found)), "spans", list(BASE))
