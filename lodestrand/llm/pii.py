"""Personal data: generated candidates, boosted trees, calibrated thresholds, redaction.

Plain patterns report e-mail addresses, IP addresses, card and telephone numbers.
Besides, generators propose, with high recall and overlaps, spans that may be other
personal data.  Features of a span's format and of the words around it go through
boosted trees; a span is selected if its score passes the threshold that was calibrated
for its kind, on formats that the trees hadn't seen.  The trees are fitted here, on the
driver, to examples that are written from rules, as no labels exist; they run as an SQL
expression.  All else is DataFrame functions.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import whole_text

# Kinds in their order, and patterns as the contract gives them.
# (?:(?<![..])|\G) lets a match start only where a run of such characters starts or
# where the last match ended; any other start inside a run fails as its first did.
# Repeats that nothing follows are possessive: Java then walks them without recursion.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Cheap signs without which a pattern has no match.
SIGNS = {"email": "@", "phone": "+"}
# Bounds in these are those of the formats: an account number has 34 characters at most,
# a mailbox name 64 and a label of a domain 63.
GENERATORS = {
    "number": r"(?<![A-Za-z0-9])\(?[0-9]++(?:[\x20().-]{1,3}+[0-9]++)*+(?![A-Za-z0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){10,30}(?![A-Za-z0-9])",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{2,63})++",
}
GENERATOR_SIGNS = {"number": "[0-9]", "account": "[A-Z]{2}[0-9]{2}", "address": r"(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)"}
#: A number has so many characters at least.
LEAST_NUMBER = 7
KINDS = (*BASE, *GENERATORS)
MARKS = {kind: f"[{kind.upper()}]" for kind in KINDS}
#: Characters before and after a span that are its context.
BEFORE, AFTER = 32, 12
# Words, in lower case and four languages, that go before personal data,
# words that go before other numbers, and what stands before or after amounts.
EDGE = r"(?:(?<![a-zà-ÿ])(?:%s)(?![a-zà-ÿ]))"
HINTS = EDGE % "tel|telephone|phone|mobile|cell|fax|call|ring|ssn|social security|passport|iban|account|e-?mail|mail|contact|reach|téléphone|portable|appele[rz]|appelez-moi|joindre|compte|courriel|sécurité sociale|passeport|telefon|handy|mobil|anrufen|rufen|erreichen|konto|kontonummer|reisepass|teléfono|móvil|llame|llámame|cuenta|correo|pasaporte|whatsapp|sms"
COUNTERS = EDGE % "isbn|issn|version|order|invoice|part|serial|ref|reference|doi|page|pages|vol|item|sku|build|id|no|population|about|in|on|since|between|commande|facture|article|numéro|le|en|environ|entre|bestellung|rechnung|artikel|seite|am|seit|etwa|zwischen|pedido|factura|artículo|página|el|unos|desde|score|result|chapter|section|figure|table|ticket|case"
MONEY, UNITS = r"[$€£#№]\s?$", r"^\s?(?:%|€|\$|£|eur|usd|km|kg|m|mm|cm|people|habitants|einwohner|habitantes|euros?|dollars?|times|years?|ans|jahre|años|bytes?|kb|mb|hz|watt|degrees|points)(?![a-zà-ÿ])"
FEATURES = ("digits", "letters", "groups", "length", "first", "second", "last", "parens", "dots", "dashes", "spaces", "check", "hint", "counter", "money", "unit")

ROUNDS, RATE, DEPTH, EXAMPLES, PRECISION, FOLDS, SEED = 30, 0.3, 3, 6_000, 0.95, 8, 11
BLOCK = 256


# -- spans by SQL


def prefix_sums(values: Column) -> Column:
    """Running sums of an array, block by block, so that long arrays cost little more than their length."""
    running = lambda part, start: F.slice(
        F.aggregate(part, F.array(start), lambda a, x: F.array_append(a, F.element_at(a, -1) + x)), F.lit(2), F.size(part)
    )
    zero = F.lit(0).cast("long")
    n = F.ceil(F.size(values) / BLOCK).cast("int")
    block = lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK))
    ks = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    totals = running(F.transform(ks, lambda k: F.aggregate(block(k), zero, lambda a, x: a + x)), zero)
    return F.flatten(F.transform(ks, lambda k: running(block(k), F.when(k > 0, F.get(totals, k - 1)).otherwise(zero))))


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return match.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")  # noqa: E731  the i-th from the right
        doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, digit(i)).otherwise(doubled(digit(i))))
        return F.when((n >= 12) & (n <= 19), total % 10 == 0).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "number":
        return F.length(match) >= LEAST_NUMBER
    return F.lit(True)


SPAN = "array<struct<start:bigint,kind:int,end:bigint,match:string>>"


def _found(df: DataFrame, text: str, kind: str, pattern: str, sign: str | None) -> DataFrame:
    """df with a column of the kind's name: start, kind, end and match of all matches.

    What lies between matches tells where each is: split() and regexp_extract_all()
    walk the text alike.
    """
    sure = F.col(text).rlike(sign) if sign and len(sign) > 1 else F.contains(F.col(text), F.lit(sign)) if sign else F.lit(True)
    df = df.select("*", F.when(sure, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("_m"))
    df = df.select("*", F.when(F.size("_m") > 0, F.split(F.col(text), pattern, -1)).alias("_g"))
    lengths = F.transform(F.col("_m"), lambda m, i: (F.length(F.get(F.col("_g"), i)) + F.length(m)).cast("long"))
    df = df.select("*", F.when(F.col("_g").isNotNull(), lengths).alias("_l"))
    df = df.select("*", F.when(F.col("_l").isNotNull(), prefix_sums(F.col("_l"))).alias("_e"))
    spans = F.transform(F.col("_m"), lambda m, i: F.struct((F.get(F.col("_e"), i) - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), F.get(F.col("_e"), i).alias("end"), m.alias("match")))
    return df.select("*", F.when(F.col("_e").isNotNull(), spans).otherwise(F.array()).cast(SPAN).alias(kind)).drop("_m", "_g", "_l", "_e")


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    plain = F.array_distinct(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(F.sort_array(plain), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


# -- features, in SQL and in Python


def _features(span: Column, text: Column) -> dict[str, Column]:
    match, start = span["match"], span["start"].cast("int")
    before = F.lower(F.substring(text, F.greatest(F.lit(1), start - (BEFORE - 1)), F.least(F.lit(BEFORE), start)))
    after = F.lower(F.substring(text, span["end"].cast("int") + 1, F.lit(AFTER)))
    count = lambda pattern: F.regexp_count(match, F.lit(pattern)).cast("int")
    part = lambda pattern: F.length(F.regexp_extract(match, pattern, 1))
    flag = lambda c: F.when(c, 1).otherwise(0)
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    # Account numbers leave 1 by 97, with letters as two digits.
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a))
    return {
        "digits": count("[0-9]"),
        "letters": count("[A-Za-z]"),
        "groups": count("[0-9]+"),
        "length": F.length(match),
        "first": part(r"^[^0-9]*([0-9]*)"),
        "second": part(r"^[^0-9]*[0-9]+[^0-9]+([0-9]+)"),
        "last": part(r"([0-9]*)[^0-9]*$"),
        "parens": count(r"[(\[]"),
        "dots": count(r"\."),
        "dashes": count("-"),
        "spaces": count(r"\x20"),
        "check": flag(match.rlike(r"^[A-Z]{2}[0-9]{2}") & (rest == 1)),
        "hint": flag(before.rlike(HINTS)),
        "counter": flag(before.rlike(COUNTERS)),
        "money": flag(before.rlike(MONEY)),
        "unit": flag(after.rlike(UNITS)),
    }


def check_digits(account: str) -> int:
    """What an account number leaves by 97; a sound one leaves 1."""
    plain = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def plain_features(match: str, before: str, after: str = "") -> list[int]:
    """As _features, of an example."""
    part = lambda pattern: len(m.group(1)) if (m := re.search(pattern, match)) else 0
    count = lambda pattern: len(re.findall(pattern, match))
    before, after = before[-BEFORE:].lower(), after[:AFTER].lower()
    flag = lambda pattern, where: int(bool(re.search(pattern, where)))
    sound = bool(re.match(r"[A-Z]{2}[0-9]{2}", match)) and check_digits(match) == 1
    return [
        count("[0-9]"), count("[A-Za-z]"), count("[0-9]+"), len(match), part(r"^[^0-9]*([0-9]*)"), part(r"^[^0-9]*[0-9]+[^0-9]+([0-9]+)"), part(r"([0-9]*)[^0-9]*$"),
        count(r"[(\[]"), count(r"\."), count("-"), count(r"\x20"), int(sound), flag(HINTS, before), flag(COUNTERS, before), flag(MONEY, before), flag(UNITS, after),
    ]


# -- examples and trees

# Phrases that go before personal data, before other numbers, and before either.
ASKING = ("You can call me at ", "Tel.: ", "phone: ", "My mobile is ", "fax ", "Please contact ", "reach me on ", "Appelez-moi au ", "Téléphone : ", "joindre le ", "portable ", "Rufen Sie mich unter ", "Telefon ", "Handy: ", "erreichen unter ", "Mi teléfono es el ", "llame al ", "móvil: ", "SSN ", "social security number ", "sécurité sociale ", "IBAN ", "account ", "Konto ", "cuenta ", "compte ", "e-mail ", "courriel ", "correo ")
COUNTING = ("order no ", "invoice ", "version ", "ISBN ", "page ", "serial ", "part ", "build ", "ticket ", "since ", "on ", "between ", "population of about ", "commande ", "facture ", "le ", "environ ", "Bestellung ", "Rechnung ", "am ", "seit ", "etwa ", "pedido ", "factura ", "el ", "unos ", "result ", "section ")
NEUTRAL = ("and then ", "it was ", "we saw ", "the answer: ", "puis ", "ensuite ", "und dann ", "das war ", "y luego ", "era ", "", "", "(", "see ", "cf. ")
FOLLOWING = (" thanks", ".", ", please", " merci", " danke", " gracias", ")", "\n", " and more", "")
MEASURING = (" km", " EUR", " people", "%", " euros", " Einwohner", " habitants", " kg")
NAMES, HOSTS = ("anna", "jo.doe", "m.weber", "lucie", "carlos77", "pat-lee", "info", "k_novak", "sales", "marie.dupont"), ("example", "mail-host", "uni-bonn", "acme", "orange", "telefonica", "post", "web")
ENDINGS = ("com", "org", "net", "de", "fr", "es", "co")
# A 9 stands for any digit, other characters for themselves.
YES_NUMBERS = ("(999) 555-9999", "999-999-9999", "999.999.9999", "1-999-555-9999", "020 7999 9999", "07999 999999", "0999 999 9999", "099 999999", "0179 9999999", "(030) 999999", "01 99 99 99 99", "06.99.99.99.99", "06-99-99-99-99", "0699999999", "919 999 999", "699 99 99 99", "699999999", "91-999-99-99", "999-99-9999", "1 85 09 78 999 999 99", "099 9999 9999", "0049 171 9999999")
NO_NUMBERS = ("1999-09-09", "09.09.1999", "09-09-2019", "2019.09.09", "1.9.99.2099", "10.0.9999", "978-9-99-999999-9", "978-9999999999", "1999-2009", "2009 - 2019", "9 999 999", "9.999.999", "99 999 999", "9.9999999", "99.99999", "2099-999999", "999-9999-99", "9999999", "99999999", "999999999999", "9999 9999 99", "100-2000-30", "19990909 1209", "99 - 99 - 99", "9999-9999", "1 000 000")
YES_ACCOUNTS = {"DE": "99999999" + "9" * 10, "FR": "9999999999" + "A" * 3 + "9" * 10, "ES": "9" * 20, "NL": "AAAA" + "9" * 10, "IT": "A" + "9" * 22, "GB": "AAAA" + "9" * 14}
NO_ACCOUNTS = ("AA99 AAAA 9999 AA99", "AA99A9A9A9A9A9A9", "AA99 9999 9999 9999 9999", "AA99" + "9" * 18, "AA99 AAAAA AAAAA AAAAA", "AA99AAAA9999AAAA9999", "AA99 AA99 AA99 AA99")
YES_ADDRESSES = ("{n}(at){h}(dot){e}", "{n}[at]{h}[dot]{e}", "{n} (at) {h} (dot) {e}", "{n} at {h} dot {e}", "{n} [at] {h}.{e}", "{n}(at){h}.{e}", "{n} [at] {h} [dot] {e}", "{n} at {h}.{h}.{e}")
NO_ADDRESSES = ("look at {h}.Then", "meet at {w}.{w}", "good at {w} dot {w}", "arrived at {w}. {w}", "back at {w}. But", "laugh at {w}.So", "at work at {w} dot {w}")
WORDS = ("noon", "home", "paris", "maths", "dawn", "school", "product", "sea", "night", "berlin", "least", "last", "once")


def _filled(rng: random.Random, form: str) -> str:
    return "".join(rng.choice("0123456789") if c == "9" else rng.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "A" else c for c in form)


def _account(rng: random.Random, country: str) -> str:
    body = _filled(rng, YES_ACCOUNTS[country])
    plain = f"{country}{98 - check_digits(f'{country}00{body}'):02d}{body}"
    return plain if rng.random() < 0.5 else " ".join(plain[i : i + 4] for i in range(0, len(plain), 4))


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, str, str, str, int, int]]:
    """(generator, match, text before, text after, label, number of the format): personal
    data and look-alikes, from rules."""
    rng, out = random.Random(seed), []
    pick = rng.choice
    for i in range(n):
        kind, good = tuple(GENERATORS)[i % 3], rng.random() < 0.5
        if kind == "number":
            forms = YES_NUMBERS if good else NO_NUMBERS
            k = rng.randrange(len(forms))
            match = _filled(rng, forms[k])
        elif kind == "account":
            forms = tuple(YES_ACCOUNTS) if good else NO_ACCOUNTS
            k = rng.randrange(len(forms))
            match = _account(rng, forms[k]) if good else _filled(rng, forms[k])
            if not good and check_digits(match) == 1:
                continue
        else:
            forms = YES_ADDRESSES if good else NO_ADDRESSES
            k = rng.randrange(len(forms))
            match = forms[k].format(n=pick(NAMES), h=pick(HOSTS), e=pick(ENDINGS), w=pick(WORDS))
        draw = rng.random()
        before = pick(ASKING if draw < (0.65 if good else 0.06) else COUNTING if draw > (0.95 if good else 0.4) else NEUTRAL)
        after = pick(MEASURING if not good and kind == "number" and rng.random() < 0.25 else FOLLOWING)
        out.append((kind, match, f"{pick(WORDS)} {pick(WORDS)}. {before}", after, int(good), 2 * k + good))
    return out


Tree = tuple  # (feature, cut, below, above), with numbers for leaves


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A tree of least loss, found greedily; ties go to the first feature and cut."""
    best, all_g, all_h = (1e-6, 0, 0), g.sum(), h.sum()
    for f in range(x.shape[1] if depth else 0):
        low_g, low_h = (np.cumsum(np.bincount(x[:, f], w))[:-1] for w in (g, h))
        gain = low_g**2 / (low_h + 1) + (all_g - low_g) ** 2 / (all_h - low_h + 1) - all_g**2 / (all_h + 1)
        if len(gain) and gain.max() > best[0] + 1e-12:
            best = (gain.max(), f, int(gain.argmax()))
    if best[0] <= 1e-6:
        return float(RATE * all_g / (all_h + 1))
    _, f, cut = best
    low = x[:, f] <= cut
    return (f, cut, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def evaluate(tree, x: list[int]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def values_of(tree, x: np.ndarray) -> np.ndarray:
    """As evaluate, of many rows."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[low], out[~low] = values_of(tree[2], x[low]), values_of(tree[3], x[~low])
    return out


def boosted(x: np.ndarray, y: np.ndarray) -> list:
    """Trees whose sum is the logit of y, each grown on the slopes that those before leave."""
    score, grown = np.zeros(len(y)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        grown.append(_grow(x, y - p, p * (1 - p), DEPTH))
        score += values_of(grown[-1], x)
    return grown


def scored(trees: list, x: list[int]) -> float:
    return sum(evaluate(t, x) for t in trees)


@lru_cache(maxsize=1)
def model() -> tuple[dict[str, list], dict[str, float]]:
    """Trees and threshold of each generator.

    Formats are dealt to folds, and the examples of a fold are scored by trees that were
    grown without it; the threshold is the least from which on the wanted share of them
    is personal data.  The trees themselves are grown on all examples.
    """
    trees, thresholds = {}, {}
    for kind in GENERATORS:
        own = [e for e in examples() if e[0] == kind]
        x, y = np.array([plain_features(m, b, a) for _, m, b, a, *_ in own]), np.array([e[4] for e in own])
        fold = np.array([e[5] // 2 for e in own]) % FOLDS
        score = np.zeros(len(y))
        for k in range(FOLDS):
            grown = boosted(x[fold != k], y[fold != k])
            score[fold == k] = sum(values_of(t, x[fold == k]) for t in grown)
        order = np.argsort(-score, kind="stable")
        right = np.cumsum(y[order]) >= PRECISION * np.arange(1, len(y) + 1)
        last = np.r_[score[order][1:] < score[order][:-1], True]  # equal scores pass together
        fine = np.flatnonzero(right & last)
        trees[kind], thresholds[kind] = boosted(x, y), float(score[order][fine[-1]]) if len(fine) else math.inf
    return trees, thresholds


def _tree_sql(tree, values: str) -> str:
    """A tree as SQL over an array of features."""
    if not isinstance(tree, tuple):
        return f"{float(tree)!r}D"
    f, cut, low, high = tree
    return f"IF({values}[{f}] <= {cut}, {_tree_sql(low, values)}, {_tree_sql(high, values)})"


def _base(rows: DataFrame) -> DataFrame:
    """rows (_text and others) with the spans of each plain pattern, and _base, all of them."""
    for kind, pattern in BASE.items():
        rows = _found(rows, "_text", kind, pattern, SIGNS.get(kind, "[0-9]"))
        rows = rows.withColumn(kind, F.filter(kind, lambda s: _valid(kind, s["match"])))
    return rows.select("*", F.concat(*BASE).alias("_base"))


def _described(rows: DataFrame, kind: str) -> DataFrame:
    """rows with the generator's candidates that lie in no plain span, and _x: each with
    its features and score."""
    rows = _found(rows, "_text", kind, GENERATORS[kind], GENERATOR_SIGNS[kind])
    fresh = F.filter(kind, lambda s: _valid(kind, s["match"]) & ~F.exists(F.col("_base"), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    rows = rows.withColumn(kind, F.when(F.size(kind) > 0, fresh).otherwise(F.col(kind)))
    described = F.transform(kind, lambda s: F.struct(s.alias("s"), F.array(*_features(s, F.col("_text")).values()).alias("x")))
    rows = rows.withColumn("_x", F.when(F.size(kind) > 0, described))
    score = " + ".join(["0.0D", *(_tree_sql(t, "x.x") for t in model()[0][kind])])
    return rows.withColumn("_x", F.expr(f"transform(_x, x -> named_struct('s', x.s, 'x', x.x, 'score', {score}))"))


def _spans(rows: DataFrame) -> DataFrame:
    """rows (_text and others) with a column of spans for each kind, and _base."""
    rows = _base(rows)
    for kind in GENERATORS:
        threshold = model()[1][kind]
        selected = F.transform(F.filter("_x", lambda x: x["score"] >= threshold), lambda x: x["s"])  # noqa: B023
        rows = _described(rows, kind).withColumn(kind, F.coalesce(selected, F.array().cast(SPAN))).drop("_x")
    return rows


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a candidate of the generators: the document's key, kind, start, end, match,
    features, score and selected.  Texts count as in scan()."""
    rows, out = _base(docs.select(F.col(f"`{key}`").alias("_key"), whole_text(text).alias("_text"))), None
    for kind in GENERATORS:
        one = _described(rows, kind).select(F.col("_key").alias(key), F.explode("_x").alias("x"))
        one = one.select(key, F.lit(kind).alias("kind"), "x.s.start", "x.s.end", "x.s.match", F.col("x.x").alias("features"), "x.score", (F.col("x.score") >= model()[1][kind]).alias("selected"))
        out = one if out is None else out.unionByName(one)
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its key, n_email, n_ip, n_card, n_phone (long), base_sha256,
    spans (string; those of the plain patterns and those that the trees select).

    Offsets are in code points, ends exclusive.  A selected span inside a plain one is
    left out.  A null or empty text has no span, a long one is scanned whole; spans that
    start together stand in the order of their kinds; null and repeated keys give a row
    each.  Other columns aren't read, whatever their names; an empty table gives an empty
    one.  No row moves between tasks.
    """
    rows = _spans(docs.select(F.col(f"`{key}`").alias("_key"), whole_text(text).alias("_text")))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select(F.col("_key").alias(key), *counts, F.sha2(_written(F.col("_base")), 256).alias("base_sha256"), _written(F.concat(F.col("_base"), *GENERATORS)).alias("spans"))


def redact_docs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a mark of its kind in place of every span; spans that overlap get the mark
    of the first, in the order of the kinds where they start together.

    A null text stays null and an empty one empty; long texts are redacted whole, repeated
    rows each.  Other columns, whatever their names, come along; an empty table stays empty.
    """
    rows = _spans(docs.select(F.struct("*").alias("_doc"), whole_text(text).alias("_text")))
    rows = rows.select("_doc", "_text", F.sort_array(F.concat(F.col("_base"), *GENERATORS)).alias("_all"))
    marks = F.array(*[F.lit(MARKS[k]) for k in KINDS])
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def add(done, s):
        gap = F.substring(F.col("_text"), (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        out = F.when(s["start"] >= done["at"], F.concat(done["out"], F.array(gap, F.element_at(marks, s["kind"] + 1)))).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), out.alias("out"))

    rows = rows.select("_doc", "_text", F.when(F.size("_all") > 0, F.aggregate("_all", none, add)).alias("_done"))
    rest = F.substring(F.col("_text"), (F.col("_done.at") + 1).cast("int"), F.length("_text"))
    new = F.when(F.col("_done").isNotNull(), F.concat(F.array_join("_done.out", ""), rest)).otherwise(F.col("_doc").getField(text))
    return rows.select(*[new.alias(c) if c == text else F.col("_doc").getField(c).alias(c) for c in docs.columns])
