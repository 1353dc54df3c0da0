"""Personal data by weak supervision, by DataFrame functions alone.

Base: patterns of four kinds with checks (below); what passes is always reported. Beyond it each kind has candidates
outside its pattern: e-mail addresses spelled out or spaced ("a (at) b dot c"), IPv6 and hardware addresses, card numbers
of 13 to 15 digits, telephone numbers without a plus sign; further kinds are account numbers and secrets. All candidates,
base spans and failed card matches included, get votes of labelers: pattern labelers (strict shape, checksum or length),
gazetteers (top-level domains, issuer digits, country and area codes, secret words) and context labelers (words before,
characters around). A vote is 1 (personal), -1 (not) or 0 (none).

Expectation-maximisation over the vote patterns estimates each labeler's reliability for each kind; a final logistic
span classifier is trained on the resulting probabilities, with the votes as features, and held near the labelers'
starting weights, so that votes no candidate of the corpus gave still count. Both see counts of vote
patterns only: at most 3^6 for each kind, however large the corpus, so they run in the driver on that bounded table,
collected by one aggregate over all documents. The classifier is then a column expression; candidates that it accepts are
added to the base.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import between, let, parts_of, running
from .common import cut

KINDS = ("email", "ip", "card", "phone")
#: Kinds with candidates beyond the base.
MORE = ("email", "ip", "card", "phone", "account", "secret")
#: The base patterns. Where a pattern's start repeats a class, a look-behind skips starts inside a run
#: (all of them fail or lie in an earlier match), and possessive loops avoid stack depth; neither changes a match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates beyond the base. None overlaps a base span of its own kind.
BEYOND = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:[\x20]?[\[({<][\x20]?(?:at|AT|@)[\x20]?[\])}>][\x20]?|[\x20](?:at|AT|@)[\x20])[A-Za-z0-9-]++(?:(?:[\x20]?[\[({<][\x20]?(?:dot|DOT|\.)[\x20]?[\])}>][\x20]?|[\x20](?:dot|DOT)[\x20]|\.)[A-Za-z0-9-]++)++(?![A-Za-z0-9._%+-]*@)",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "phone": r"(?=[(0-9])(?<![0-9A-Za-z+.,(-])(?<![0-9)][\x20/-])\(?[0-9]{2,5}\)?(?:[\x20/-]\(?[0-9]{2,5}\)?){1,4}(?![0-9A-Za-z-])(?![\x20/][0-9(])",
    "account": r"(?=[0-9])(?<![0-9+])(?<!\+[0-9]{1,3}[\x20-])[0-9](?:[\x20-]?[0-9])++",
    "secret": r"[A-Za-z0-9_]{20,}+",
}
#: What a text must hold to be looked at for a kind at all.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
GATES_BEYOND = {
    "email": r"[\[({<][\x20]?(?:at|AT|@)[\x20]?[\])}>]|[\x20]@[\x20]|[\x20](?:dot|DOT)[\x20]|[\[({<][\x20]?(?:dot|DOT)", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:",
    "phone": r"[0-9]\)?[\x20/-]\(?[0-9]", "account": r"[0-9](?:[\x20-]?[0-9]){8}", "secret": "[0-9]",
}
#: Signs of which a text must hold one before its gate is tried: a search for a fixed string takes little time.
HOLDS = {"email": ("dot", "DOT", " @ ", "@)", "@]", "@}", "@>", "at)", "at]", "at}", "at>", "AT)", "AT]", "AT}", "AT>", "at )", "at ]", "@ )", "@ ]", "AT )", "AT ]", "at }", "at >", "AT }", "AT >", "@ }", "@ >"), "ip": (":",)}
#: Gazetteers, and words before a span that speak for its kind.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "uk", "eu", "us", "ca", "ch", "at", "it", "nl")
WORDS_BEFORE = {
    "email": "mail|contact|write|address|kontakt|correo|courriel",
    "ip": "ip|host|server|addr|address|login|from",
    "card": "card|visa|credit|debit|payment|pay|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|cell|whatsapp|telefon|appel",
    "account": "account|card|iban|number|konto|compte|cuenta|ssn|id",
    "secret": "token|key|secret|password|passwd|pwd|auth|bearer|credential",
}
LABELERS = ("shape", "check", "gazetteer", "before", "around", "own")
#: Words that are no name in a spelled-out address.
PLAIN = "the|a|an|this|that|it|me|us|you|look|be|is|are|here|there|one|our|my|your|in|on|and|or|der|die|das|le|la|el|los"
#: Starting accuracy of the votes, rounds, starting shares of personal data among base spans and among candidates beyond
#: them, votes' worth of observations that the start counts as, least probability that is accepted, signs before a span.
START, ROUNDS, PRIORS, WORTH, ACCEPT, BEFORE = 0.75, 25, {True: 0.95, False: 0.15}, 40, 0.5, 24
#: Weights at which the classifier starts and near which it is held: a candidate needs two votes more for than against.
FIRST, NEAR = [-2.25] + [1.5] * 6, 0.1
SPAN = "struct<start:int,end:int,text:string,before:string,left:string,right:string>"


def _matches(text: Column, pattern: str, gate: str, holds: tuple[str, ...] = ()) -> Column:
    """Array of a pattern's leftmost non-overlapping matches: start, end (code points), text, and what stands around.

    `before` are the BEFORE signs in front of the match, back to the match before it at most; `left` and `right` are the
    signs next to it, empty at a neighbouring match. All come from the gaps between matches, in one pass over the text.
    """
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.slice(gaps, F.lit(2), F.greatest(F.size(gaps), F.lit(1))).alias("after"))

    def place(p: Column, at: Column) -> Column:
        begin = at + F.length(p["gap"])
        return F.struct(begin.alias("start"), (begin + F.length(p["hit"])).alias("end"), p["hit"].alias("text"), F.right(p["gap"], F.lit(BEFORE)).alias("before"), F.right(p["gap"], F.lit(1)).alias("left"), F.left(p["after"], F.lit(1)).alias("right"))

    size = lambda p: F.length(p["gap"]) + F.length(p["hit"])
    # One gap more than matches: without a match it is no pair.
    found = let(F.filter(pairs, lambda p: p["hit"].isNotNull()), lambda hits: let(running(F.transform(hits, size), F.lit(0)), lambda at: F.transform(hits, lambda p, i: place(p, at[i]))))
    there = reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in holds)) if holds else F.lit(True)
    return F.when(there & text.rlike(gate), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _passes(kind: str, text: Column) -> Column:
    if kind == "ip":
        # At most three digits after leading zeros, so that the cast can't overflow.
        return F.forall(F.split(text, r"\."), lambda p: p.rlike("^0*[0-9]{1,3}$") & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        d = _digits(text)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | bool = False) -> Column:
    return F.when(yes, 1).when(no if isinstance(no, Column) else F.lit(no), -1).otherwise(0)


def _votes(kind: str, s: Column) -> Column:
    """The labelers' votes for span s, as a struct."""
    t, digits = s["text"], _digits(s["text"])
    before, left, right = F.lower(s["before"]), s["left"], s["right"]
    n = F.length(digits)
    one = F.length(F.array_join(F.array_distinct(F.split(digits, "")), ""))
    last = F.lower(F.regexp_extract(t, "([A-Za-z0-9-]+)[^A-Za-z0-9]*$", 1))
    date = t.rlike(r"^(19|20)[0-9]{2}[/-][0-9]{2}([/-][0-9]{2})?$|^[0-9]{2}[/-][0-9]{2}[/-]([0-9]{2}){1,2}$|^(19|20)[0-9]{2}[ /-](19|20)[0-9]{2}$")
    colons = F.length(F.regexp_replace(t, "[^:]", ""))
    spelled = t.rlike(r"[\[({<]|[\x20](dot|DOT)[\x20]|@")
    shape = {
        "email": _vote(t.rlike(r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$") | spelled, ~t.rlike("[A-Za-z]") | ~spelled),
        "ip": _vote(t.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$") | t.rlike("^([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$") | t.rlike("^([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$") | t.rlike("^[0-9A-Fa-f]{4}:.*::"), t.rlike(r"[0-9]{4}\.|\.[0-9]{4}") | (t.rlike(":") & ~t.rlike("[A-Fa-f]|::"))),
        "card": _vote(t.rlike(r"^[0-9]{13,16}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$"), n < 12),
        "phone": _vote(t.rlike(r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[0-9 .-]{6,}$") | (t.rlike(r"^\(?0[0-9]|^\([0-9]{3}\)|^[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}$") & ~date), (n < 8) | date),
        "account": _vote(t.rlike("^[0-9]+$") & F.length(t).between(12, 19), n < 9),
        "secret": _vote(t.rlike("^[0-9a-f]{32,64}$") | (t.rlike("[0-9]") & t.rlike("[a-z]") & t.rlike("[A-Z]")), ~t.rlike("[0-9]") | ~t.rlike("[A-Za-z]")),
    }[kind]
    check = {
        "email": _vote((last.rlike("^[a-z]{2,3}$") | last.isin(*DOMAINS) | t.rlike("@[A-Za-z0-9]")) & (F.length(t) <= 254), ~last.rlike("[a-z]{2}") | t.rlike(r"\.\.|^\.")),
        "ip": _vote(F.when(t.rlike(":"), (colons == 7) | ((colons == 5) & ~t.rlike("::")) | t.rlike("::")).otherwise(_passes("ip", t)), F.when(t.rlike(":"), t.rlike("::.*::")).otherwise(~_passes("ip", t))),
        "card": _vote(luhn(digits), ~luhn(digits)),
        "phone": _vote(n.between(8, 15) & ~date, ~n.between(7, 15)),
        "account": _vote(n.between(15, 19), (n < 11) | (n > 19)),
        "secret": _vote((n * 6 >= F.length(t)) & (n < F.length(t)), n == F.length(t)),
    }[kind]
    gazetteer = {
        "email": _vote(last.isin(*DOMAINS) & spelled, ~t.rlike("@[A-Za-z0-9]") & ~last.isin(*DOMAINS)),
        "ip": _vote(F.when(t.rlike(":"), t.rlike("^(?i)(2[0-9a-f]{3}|3[0-9a-f]{3}|f[cde][0-9a-f]{2}|([0-9a-f]{2}:){5}[0-9a-f]{2}$)")).otherwise(~t.rlike(r"^(0|127|169\.254|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.")), t.rlike(r"^(0|127)\.|^::1$")),
        "card": _vote(digits.rlike("^(3[47]|4|5[1-5]|2[2-7]|6)"), digits.rlike("^0")),
        "phone": _vote(F.when(t.startswith("+"), digits.rlike("^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")).otherwise(digits.rlike("^0[1-9]|^[2-9][0-9]{2}[2-9][0-9]{6}$"))),
        "account": _vote(digits.rlike("^[1-9]"), digits.rlike("^000")),
        "secret": _vote(before.rlike(f"({WORDS_BEFORE['secret']})")),
    }[kind]
    cue = _vote(before.rlike("=|:") if kind == "secret" else before.rlike(rf"(?:{WORDS_BEFORE[kind]})[^a-z]*$"))
    around = _vote(~left.rlike(r"[\p{L}\p{N}_]") & ~right.rlike(r"[\p{L}\p{N}_]") & ~left.rlike(r"[$€£#]") & ~right.rlike("[%€$]"), left.rlike("[0-9$€£#]") | right.rlike("[0-9%€$]"))
    own = {
        "email": _vote(F.lit(False), t.rlike(rf"(?i)^({PLAIN})[\x20]|[\x20](at|@)[\x20]({PLAIN})[\x20]")),
        "ip": F.lit(0),
        "phone": _vote(F.lit(False), date | (one <= 2)),
    }.get(kind, _vote(F.lit(False), one <= 2))
    return F.struct(shape.alias("shape"), check.alias("check"), gazetteer.alias("gazetteer"), cue.alias("before"), around.alias("around"), own.cast("int").alias("own"))


def _voted(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` of docs, with arrays base_<kind> and more_<kind> of spans (start, end, v: votes)."""
    text = F.col("text")
    found = docs.select(*keep, *(_matches(text, PATTERNS[k], GATES[k]).alias(f"base_{k}") for k in KINDS), *(_matches(text, BEYOND[k], GATES_BEYOND[k], HOLDS.get(k, ())).alias(f"more_{k}") for k in BEYOND))
    marked = lambda k: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _votes(k, s).alias("v"))
    n = lambda s: F.length(_digits(s["text"]))
    apart = lambda s: s["text"].rlike("[^0-9]")
    short = lambda s: n(s).between(13, 15) & luhn(_digits(s["text"]))
    # Digits in groups are a telephone number up to 12, an account number from 13 on.
    wanted = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: F.lit(True),
        "phone": lambda s: n(s).between(7, 12),
        "account": lambda s: (n(s) >= F.when(apart(s), 13).otherwise(9)) & ~_passes("card", s["text"]) & ~short(s),
        "secret": lambda s: s["text"].rlike("[0-9]"),
    }
    spans = {f"base_{k}": F.transform(F.filter(f"base_{k}", _of(k, lambda k, s: _passes(k, s["text"]))), marked(k)) for k in KINDS}
    spans |= {f"more_{k}": F.transform(F.filter(f"more_{k}", keep), marked(k)) for k, keep in wanted.items()}
    spans |= {"more_card": F.transform(F.filter("more_account", short), marked("card"))}
    return found.withColumns(spans)


def _of(kind: str, function):
    """A function of (kind, span) as the one-argument function that higher-order functions take."""
    return lambda x: function(kind, x)


class Aggregator:
    """Reliabilities of labelers by kind, and the weights of the final span classifier.

    patterns: (kind, whether a base span, votes, number of candidates). Base spans and candidates beyond them share the
    labelers' reliabilities, but not the class prior: nearly all base spans are personal data, which says nothing of
    the others. The classifier is trained on the candidates that it decides on.
    """

    def __init__(self, patterns: list[tuple[str, bool, tuple[int, ...], int]]):
        self.reliability = {k: self._em([(o, v, n) for kind, o, v, n in patterns if kind == k]) for k in MORE}
        self.weights = self._logistic([(k, v, n, self.posterior(k, v)) for k, o, v, n in patterns if not o])

    @staticmethod
    def _em(rows: list[tuple[bool, tuple[int, ...], int]]):
        """Dawid-Skene for two classes: priors, and for each labeler and class the chances of votes -1, 0, 1.

        Smoothed towards the start values by WORTH votes, so that a kind with few candidates stays near them.
        """
        size, rest = len(LABELERS), (1 - START) / 2
        first = {-1: rest, 0: 0.25 - rest + START / 2, 1: START / 2 + 0.25}
        first = {v: p / sum(first.values()) for v, p in first.items()}
        start = [(first, {-v: p for v, p in first.items()})] * size
        priors, chance = dict(PRIORS), start
        for _ in range(ROUNDS):
            total, hits = {o: WORTH for o in PRIORS}, {o: WORTH * p for o, p in PRIORS.items()}
            sums = [({-1: 0.0, 0: 0.0, 1: 0.0}, {-1: 0.0, 0: 0.0, 1: 0.0}) for _ in range(size)]
            for o, votes, n in rows:
                p = Aggregator._posterior(priors[o], chance, votes)
                total[o], hits[o] = total[o] + n, hits[o] + n * p
                for i, v in enumerate(votes):
                    sums[i][0][v] += n * p
                    sums[i][1][v] += n * (1 - p)
            priors = {o: hits[o] / total[o] for o in PRIORS}
            chance = [tuple({v: (sums[i][c][v] + WORTH * start[i][c][v]) / (sum(sums[i][c].values()) + WORTH) for v in (-1, 0, 1)} for c in (0, 1)) for i in range(size)]
        return priors, chance

    @staticmethod
    def _posterior(prior: float, chance, votes: tuple[int, ...]) -> float:
        z = math.log(prior / (1 - prior)) + sum(math.log(chance[i][0][v] / chance[i][1][v]) for i, v in enumerate(votes))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def posterior(self, kind: str, votes: tuple[int, ...]) -> float:
        """The chance that a candidate beyond the base with these votes is personal data."""
        priors, chance = self.reliability[kind]
        return self._posterior(priors[False], chance, votes)

    @staticmethod
    def _logistic(rows, steps: int = 400, rate: float = 0.5, decay: float = NEAR) -> dict[str, list[float]]:
        """Weights for each kind: bias, then one for each labeler."""
        out = {}
        for kind in MORE:
            own = [(v, n, p) for k, v, n, p in rows if k == kind]
            total, w = sum(n for _, n, _ in own) or 1, list(FIRST)
            for _ in range(steps):
                g = [decay * (x - y) for x, y in zip(w, FIRST, strict=True)]
                for v, n, p in own:
                    z = w[0] + sum(a * b for a, b in zip(w[1:], v, strict=True))
                    e = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / total
                    g[0] += e
                    for i, x in enumerate(v):
                        g[i + 1] += e * x
                w = [a - rate * b for a, b in zip(w, g, strict=True)]
            out[kind] = w
        return out

    def probability(self, kind: str, votes: Column) -> Column:
        w = self.weights[kind]
        z = F.lit(w[0])
        for name, c in zip(LABELERS, w[1:], strict=True):
            z = z + F.lit(c) * votes[name]
        return 1 / (1 + F.exp(-z))


def fit(docs: DataFrame) -> Aggregator:
    """Count the vote patterns of all candidates of docs (text) and learn from them."""
    return _learn(_voted(docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))))


def _learn(voted: DataFrame) -> Aggregator:
    spans = [(k, f"base_{k}") for k in KINDS] + [(k, f"more_{k}") for k in MORE]
    one = lambda c: lambda k, s: F.struct(F.lit(k).alias("kind"), F.lit(c.startswith("base")).alias("base"), s["v"].alias("v"))
    every = F.concat(*(F.transform(c, _of(k, one(c))) for k, c in spans))
    counts = voted.select(F.explode(every).alias("x")).groupBy("x.kind", "x.base", *(F.col(f"x.v.{n}").alias(n) for n in LABELERS)).agg(F.count(F.lit(1)).alias("n"))
    return Aggregator([(r["kind"], r["base"], tuple(r[n] for n in LABELERS), r["n"]) for r in sorted(counts.collect())])


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(kind + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def _accepted(voted: DataFrame, model: Aggregator) -> DataFrame:
    """more_<kind> cut down to what the classifier accepts."""
    return voted.withColumns({f"more_{k}": F.filter(f"more_{k}", _of(k, lambda k, s: model.probability(k, s["v"]) >= ACCEPT)) for k in MORE})


def detect(docs: DataFrame, model: Aggregator | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    A null text is empty: no spans, and the hash of the empty string. A null doc_id keeps its row; repeated rows are
    scanned each; no rows give no rows. Texts are matched once: spans and votes go through a checkpoint.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    voted = cut(_voted(own, "doc_id"))
    found = _accepted(voted, model or _learn(voted))
    base = F.concat(*(_listed(k, F.col(f"base_{k}")) for k in KINDS))
    # By kind as listed (the method's own kinds after the base's), then start, then end.
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    every = F.concat(*(_listed(k, F.array_sort(F.concat(*(bare(f"{c}_{k}") for c in ("base", "more") if c == "more" or k in KINDS)))) for k in MORE))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))


def redact(docs: DataFrame, model: Aggregator | None = None) -> DataFrame:
    """docs with each span of `text` replaced by its kind in brackets, other columns as they are, whatever their names.

    Spans that overlap are replaced together, by the kind of the one that starts first (the longer, if they start
    together). A null text stays null.
    """
    model = model or fit(docs)
    own = docs.select(F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("rest"))
    found = _accepted(_voted(own, "text", "rest"), model)
    spans = [(k, f"base_{k}") for k in KINDS] + [(k, f"more_{k}") for k in MORE]
    tagged = F.concat(*(F.transform(c, _of(k, lambda k, s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(f"[{k.upper()}]").alias("tag")))) for k, c in spans))
    text = F.col("text")
    # A last mark at the end, without tag, takes in the text after the last span.
    marks = F.concat(F.array_sort(tagged), F.array(F.struct(F.length(text).alias("start"), (-F.length(text)).alias("back"), F.lit("").alias("tag"))))

    def rendered(marks: Column, parts: Column) -> Column:
        """What stands before each mark, from the end of those before it, and its tag; an overlapping span's rest is
        covered by the tag before it."""
        ends = running(F.transform(marks, lambda x: -x["back"]), F.lit(0), lambda a, b: F.greatest(a, b))
        return let(ends, lambda at: F.array_join(F.transform(marks, lambda x, i: F.when(x["start"] >= at[i], F.concat(between(parts, at[i], x["start"]), x["tag"])).otherwise("")), ""))

    parts = let(marks, lambda m: let(parts_of(text), lambda p: rendered(m, p)))
    out = found.select(F.when(F.size(tagged) > 0, parts).otherwise(text).alias("text"), "rest")
    return out.select(*((F.col("text") if c == "text" else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))
