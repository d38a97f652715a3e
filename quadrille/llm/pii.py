"""Personal data by candidate gradient boosting (native).

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers that pass their checks; these always
stay.  Beside them, generators of high recall propose further, overlapping spans, also of secrets (tokens, keys,
passwords): nearly any group of digits, string of hexadecimal groups, address written out, or long string of letters and
digits.  Features of their format and of the text around them go through boosted trees; spans whose calibrated
probability reaches the threshold of their kind are added, if they overlap no base span and no better one.

The trees are fitted on SAMPLE made-up texts, a bounded sample in which each span is labelled, with the same
expressions for candidates and features that are used on the corpus.  Three fifths of them train, a fifth calibrates and
sets the thresholds, and the accuracy that ``model`` reports is measured on the last fifth, over all spans written there.

Defined cases: a null or empty text has no spans (empty string, and the digest of the empty string).  Repeated rows are
scanned each.  An empty table gives an empty result.  ``report`` and ``detect`` ignore other columns; ``redact`` carries
them and replaces one named spans.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.boosting import apply_tree, calibrated, fit_trees, threshold_for, tree_column
from quadrille.llm.common import whole

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds that base patterns find.
BASE_KINDS = KINDS[:4]
#: Made-up texts to fit on, and the precision that thresholds are set for.
SAMPLE, PRECISION = 5000, 0.97
#: Spans that are summed at once when lengths are turned into places.
CHUNK = 64

#: The base patterns.  Possessive repeats and look-behinds find the same matches in linear time and constant stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must match for its base pattern to be tried.
_TRIED = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}

_NAME = r"(?i)(?<![\p{L}0-9._%+-])[\p{L}0-9_%+-]++(?:\.[\p{L}0-9_%+-]++)*+"
#: Generators of high recall: kind, pattern, and what a text must match for it to be tried.
PROPOSED = [
    ("email", _NAME + r"\x20?(?:\(at\)|\[at\]|\{at\}|<at>|\x20@\x20?|@\x20)\x20?[\p{L}0-9-]++(?:(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\x20dot\x20)\x20?|\x20?\.\x20?)[\p{L}0-9-]++)++", r"(?i)[(\[{<]at[)\]}>]|@"),
    ("email", _NAME + r"\x20at\x20[\p{L}0-9-]++(?:(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\x20dot\x20)\x20?|\.)[\p{L}0-9-]++)++", r"(?i)\x20at\x20[\p{L}0-9-]++(?:\.[\p{L}0-9]|\x20?[(\[{<\x20]dot)"),
    ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4})?(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?:::)?(?![0-9A-Za-z:])", r":[0-9A-Fa-f]{1,4}:"),
    ("ip", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4})?(?![0-9A-Za-z:])", "::"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\x20\.\x20|\(dot\))\x20?[0-9]{1,3}){3}(?![0-9.])", r"[0-9]\x20?[\[(\x20](?:\.|dot)[\])\x20]"),
    ("card", r"(?<![0-9])[0-9](?:[\x20./_-]{0,3}[0-9]){11,18}(?![0-9])", r"[0-9](?:[\x20./_-]{0,3}[0-9]){11}"),
    ("phone", r"(?<![0-9A-Za-z+.])(?:\+|00)?\(?[0-9]{1,5}\)?(?:[\x20./-]{1,3}\(?[0-9]{2,8}\)?){1,5}(?![0-9])", r"[0-9]\)?[\x20./-]{1,3}\(?[0-9]{2}"),
    ("phone", r"(?<![0-9A-Za-z+.])[0-9]{8,14}(?![0-9A-Za-z])", r"[0-9]{8}"),
    ("secret", r"(?<![A-Za-z0-9_+/.-])(?=[A-Za-z_+/.-]*[0-9])[A-Za-z0-9_+/.-]{16,200}+=*", r"[A-Za-z0-9_+/.-]{16}"),
    ("secret", r"(?i)(?<=(?:token|secret|passwort|password|passwd|pwd|key)[\"']?\x20?[:=]\x20?[\"']?)[^\s\"',;:=]{6,200}+", r"(?i)(?:token|secret|pass|pwd|key)"),
]

_BEFORE, _AFTER = 32, 12
_HINTS = {
    "hint_phone": r"(?i)(tel|phone|call|fax|mobil|cell|dial|whatsapp|ring)[^0-9]*$",
    "hint_card": r"(?i)(card|visa|master|amex|credit|debit|payment|kreditkarte)[^0-9]*$",
    "hint_ip": r"(?i)(\bip|host|server|addr|client|ping|route)[^0-9]*$",
    "hint_mail": r"(?i)(mail|contact|write|reach|send)[^0-9]*$",
    "hint_secret": r"(?i)(token|secret|key|passw|passwd|pwd|bearer|auth|credential)[^0-9A-Za-z]*$",
    "hint_other": r"(?i)(order|invoice|version|isbn|ref|item|model|part|ticket|date|no\.|#|\bv|at|commit|sha|hash|file|path|rev|id|pages?|table)[^0-9A-Za-z]*$",
}
FEATURES = ("kind", "length", "digits", "dots", "dashes", "spaces", "slashes", "colons", "small", "large", "brackets", "marks", "groups", "longest", "hex", "luhn", "date", "clock", "zero", "glued", "tail", *_HINTS)

_SPANS = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _running(sizes: Column) -> Column:
    """For each size the sum of those before it; in chunks, so that many spans cost little more than their number."""
    n = F.size(sizes)
    chunks = F.sequence(F.lit(0), F.ceil(n / CHUNK).cast("int") - 1)
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    sums = F.transform(chunks, lambda c: total(F.slice(sizes, c * CHUNK + 1, F.lit(CHUNK))))
    starts = _let(sums, lambda s: F.transform(chunks, lambda c: total(F.slice(s, F.lit(1), c))))
    inside = lambda start, c: F.transform(F.sequence(F.lit(0), F.least(F.lit(CHUNK), n - c * CHUNK) - 1), lambda j: start + total(F.slice(sizes, c * CHUNK + 1, j)))
    return F.flatten(F.transform(starts, inside))


def _matches(text: Column, pattern: str) -> Column:
    """start, end (code points, exclusive), text, before and after of every match."""

    def placed(found: Column) -> Column:
        def out(pieces: Column) -> Column:
            sizes = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(pieces, i)))
            return _let(
                sizes,
                lambda s: _let(
                    _running(s),
                    lambda before: F.transform(
                        found,
                        lambda m, i: F.struct(
                            (F.get(before, i) + F.length(F.get(pieces, i))).alias("start"),
                            (F.get(before, i) + F.get(s, i)).alias("end"),
                            m.alias("text"),
                            F.right(F.get(pieces, i), F.lit(_BEFORE)).alias("before"),
                            F.left(F.get(pieces, i + 1), F.lit(_AFTER)).alias("after"),
                        ),
                    ),
                ),
            )

        return F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), out)).otherwise(F.array().cast(_SPANS))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(turned, k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, text: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return text.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        n = F.length(_digits(text))
        return F.when(n.between(13, 19), _luhn(_digits(text))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """kind (its place in KINDS), start and end of all base matches, in this order."""

    def of(k: int, kind: str) -> Column:
        tried = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_TRIED[kind])
        found = F.when(tried, _matches(text, BASE[kind])).otherwise(F.array().cast(_SPANS))
        good = F.filter(found, lambda m: _holds(kind, m.text))
        return F.transform(good, lambda m: F.struct(F.lit(k).alias("kind"), m.start.alias("start"), m.end.alias("end")))

    return F.concat(*[of(k, kind) for k, kind in enumerate(BASE_KINDS)])


def proposals(text: Column) -> Column:
    """kind, start, end and features of all candidates, which may overlap."""

    def of(k: int, pattern: str, tried: str) -> Column:
        found = F.when(text.rlike(tried), _matches(text, pattern)).otherwise(F.array().cast(_SPANS))
        return F.transform(found, lambda m: F.struct(F.lit(k).alias("kind"), m.start.alias("start"), m.end.alias("end"), _features(k, m).alias("x")))

    return F.concat(*[of(KINDS.index(kind), pattern, tried) for kind, pattern, tried in PROPOSED])


def _features(kind: int, m: Column) -> Column:
    count = lambda pattern: F.size(F.regexp_extract_all(m.text, F.lit(pattern), F.lit(0)))
    flag = lambda c: F.when(c, 1).otherwise(0)
    values = {
        "kind": F.lit(kind),
        "length": F.length(m.text),
        "digits": F.length(_digits(m.text)),
        "dots": count(r"\."),
        "dashes": count("-"),
        "spaces": count(" "),
        "slashes": count("/"),
        "colons": count(":"),
        "small": count("[a-z]"),
        "large": count("[A-Z]"),
        "brackets": count(r"[(\[{<]"),
        "marks": count(r"[_+/=@%]"),
        "groups": count("[0-9]+"),
        "longest": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(m.text, F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x))), F.lit(0)),
        "hex": flag(m.text.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "luhn": flag(F.when(F.length(_digits(m.text)).between(13, 19), _luhn(_digits(m.text))).otherwise(F.lit(False))),
        "date": flag(m.text.rlike(r"^\(?(?:[0-3]?[0-9][\x20./-][01]?[0-9][\x20./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[\x20./-][01]?[0-9][\x20./-][0-3]?[0-9])\b")),
        "clock": flag(m.text.rlike("^[0-2]?[0-9]:[0-5][0-9](?::[0-5][0-9])?$")),
        "zero": flag(m.text.rlike(r"^\(?0")),
        "glued": flag(m.before.rlike(r"[0-9A-Za-z/.,#=+-]$")),
        "tail": flag(m.after.rlike(r"^(?:[0-9A-Za-z/=]|[.,-][0-9])")),
    } | {k: flag(m.before.rlike(v)) for k, v in _HINTS.items()}
    return F.array(*[values[k].cast("double") for k in FEATURES])


def made_up(n: int = SAMPLE, seed: int = 7) -> list[tuple[int, str, str, str, str]]:
    """(id, before, span, after, kind or ''): texts around one span each, personal or not."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    of = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    word = lambda: of("abcdefghijklmnopqrstuvwz", r.randint(2, 9))
    name = lambda: r.choice([word(), word().capitalize(), word() + "." + word(), word() + d(2), word()[0] + "_" + word()])
    small, every = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def numbered(ok: bool) -> str:
        body = r.choice("3456") + d(r.choice([14, 14, 14, 13, 12]))
        total = sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(body)))
        check = -total % 10
        number = body + str(check if ok else (check + r.randint(1, 9)) % 10)
        sep = r.choice([".", "/", "_", " - ", "  ", "-", " ", ""])
        return sep.join(number[k : k + 4] for k in range(0, len(number), 4))

    def email() -> str:
        at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), ("{at}", "{dot}"), (" (at) ", " (dot) "), ("[at]", "."), (" @ ", "."), ("@ ", " . "), (" AT ", " DOT "), ("<at>", "<dot>")])
        return f"{name()}{at}{word()}{r.choice(['', dot + word()])}{dot}{r.choice(['com', 'org', 'net', 'de', 'co', 'example'])}"

    def address() -> str:
        hexes = [of("0123456789abcdef", r.randint(1, 4)) for _ in range(8)]
        cut = r.randint(1, 6)
        four = [str(r.randint(0, 255)) for _ in range(4)]
        made = r.choice([":".join(hexes), ":".join(hexes[:cut]) + "::" + ":".join(hexes[cut + 1 :][: 7 - cut]), "2001:db8::" + hexes[0], "fe80::" + ":".join(hexes[:4]), r.choice(["[.]", "(.)", " [.] ", " . "]).join(four)])
        return made.upper() if r.random() < 0.2 else made

    def phone() -> str:
        a, b, c = str(r.randint(2, 9)) + d(2), str(r.randint(2, 9)) + d(2), d(4)
        return r.choice([f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(2)}/{d(7)}", f"00{d(2)} {d(3)} {d(6)}", f"00 {d(2)} {d(2)} {d(3)} {d(4)}", f"0{d(4)} {d(6)}", f"0{d(9)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{a} - {b} - {c}"])

    def secret() -> str:
        return r.choice([of("0123456789abcdef", r.choice([32, 40, 64])), of(every, r.randint(20, 44)), "sk-" + of(every, 32), "ghp_" + of(every, 36), "AKIA" + of(every.upper(), 16), of(every, 22) + "/" + of(every, 20) + "=", f"{of(every, 20)}.{of(every, 30)}.{of(every, 24)}"])

    def password() -> str:
        return r.choice([of(every + "!#_-", r.randint(8, 14)), word() + d(3) + "!", word().capitalize() + d(4)])

    def date() -> str:
        y, m, x = r.randint(1900, 2030), r.randint(1, 12), r.randint(1, 28)
        s = r.choice("-./ ")
        return r.choice([f"{y}{s}{m:02}{s}{x:02}", f"{x:02}{s}{m:02}{s}{y}", f"{y}{m:02}{x:02}", f"{x}.{m}.{y}"])

    clock = lambda: f"{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}" + r.choice(["", "", f":{d(2)}"])
    unit = lambda: "-".join(of("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))
    place = lambda: "/".join([word(), word() + d(2), word()]) + r.choice([".html", ".txt", "/" + d(5), ""])
    hints = {
        "email": ["mail ", "contact: ", "write to ", "reach us: "], "phone": ["tel ", "tel. ", "call ", "phone: ", "mobile ", "fax: "], "card": ["card ", "visa ", "credit card: ", "payment by "],
        "ip": ["ip ", "server ", "host ", "client "], "": ["order ", "invoice ", "version ", "ref. ", "item #", "date: ", "part no. ", "commit ", "file ", "isbn ", "page ", "id "],
        "secret": ["token = \"", "token: ", "api_key=", "secret = '", "api key ", "Bearer ", "auth token ", "access key: ", "credential "],
    }
    makers = [
        (email, "email", 0.4), (address, "ip", 0.5), (lambda: numbered(True), "card", 0.5), (phone, "phone", 0.5), (secret, "secret", 0.85), (password, "secret", 2),
        (date, "", 0.5), (clock, "", 0.3), (lambda: numbered(False), "", 0.5), (lambda: d(r.choice([12, 14, 16])), "", 0.5), (unit, "", 0.5), (place, "", 0.5), (lambda: of("0123456789abcdef", 40), "", 2),
        (lambda: f"{d(2)}-{d(3)}-{d(2)}", "", 0.5), (lambda: f"{d(3)}/{d(2)}/{d(3)}", "", 0.5), (lambda: f"{word()} at {word()}. {word().capitalize()}", "", 0.3), (lambda: f"{word()} at {word()}.{word()}", "", 0.3),
        (lambda: " ".join(d(r.randint(2, 4)) for _ in range(3)), "", 0.5), (lambda: " ".join(d(r.randint(1, 3)) for _ in range(6)), "", 0.3), (lambda: f"{d(2)}.{d(3)}.{d(3)}", "", 0.5), (lambda: f"{d(4)}-{d(4)}-{d(4)}", "", 0.5),
        (lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", "", 0.7), (lambda: f"{word()}-{word()}-{word()}-{d(2)}", "", 0.3), (lambda: of(small, r.randint(18, 40)) + d(1), "", 0.3), (lambda: f"{word()}::{word()}::{word()}", "", 0.3), (lambda: f"{d(1)}::{d(1)}", "", 0.3),
    ]
    out = []
    for k in range(n):
        make, kind, hinted = r.choice(makers[:6]) if r.random() < 0.5 else r.choice(makers[6:])
        before = " ".join(word() for _ in range(r.randint(1, 5))) + " "
        if hinted == 2 and kind:
            before += r.choice(["password: ", "password=", "pwd = ", "Passwort: ", "secret: \""])
        elif r.random() < hinted:
            before += r.choice(hints[kind])
        quote = before[-1] if before[-1] in "\"'" else ""
        after = quote + r.choice(["", ".", ",", ")", "\n"]) + " " + " ".join(word() for _ in range(3))
        out.append((k, before, make(), after, kind))
    return out


_fitted: dict[int, tuple] = {}


def model(spark: SparkSession, sample: int = SAMPLE) -> tuple[float, list, tuple[float, float], list[float], dict]:
    """Start, trees, calibration, threshold of each kind, and accuracy on texts that neither trained nor calibrated.

    Recall counts every personal span of those texts, whether or not a generator proposes it.
    """
    if sample in _fitted:
        return _fitted[sample]
    texts = made_up(sample)
    df = spark.createDataFrame([(k, b + s + a) for k, b, s, a, _ in texts], "id long, text string")
    rows = df.select("id", F.explode(proposals(F.col("text"))).alias("c")).select("id", "c.kind", "c.start", "c.end", "c.x").collect()
    x, y, fold = np.array([r.x for r in rows]), np.zeros(len(rows)), np.array([r.id % 5 for r in rows])
    for k, r in enumerate(rows):
        _, before, span, _, kind = texts[r.id]
        shared = min(r.end, len(before) + len(span)) - max(r.start, len(before))
        y[k] = kind == KINDS[r.kind] and 2 * shared > len(span) and 2 * shared > r.end - r.start
    start, trees = fit_trees(x[fold < 3], y[fold < 3])
    score = start + sum(apply_tree(t, x) for t in trees)
    scale = calibrated(score[fold == 3], y[fold == 3])
    p = 1 / (1 + np.exp(-(scale[0] * score + scale[1])))
    bars = []
    for k in range(len(KINDS)):
        mine = (fold == 3) & (x[:, 0] == k)
        bars.append(max(0.5, threshold_for(p[mine], y[mine], PRECISION)) if mine.any() else 1.01)
    said = (fold == 4) & (p >= np.array(bars)[x[:, 0].astype(int)])
    written = {k for k, *_, kind in texts if k % 5 == 4 and kind}
    found = {r.id for r, good in zip(rows, said & (y == 1), strict=True) if good}
    told = {"accuracy": float((said == (y == 1))[fold == 4].mean()), "precision": float(y[said].mean()), "recall": len(found & written) / len(written)}
    _fitted[sample] = (start, trees, scale, bars, told)
    return _fitted[sample]


def _named(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base and every (arrays of kind, start, end; kind is a place in KINDS), and text."""
    return _detected(docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")), ["doc_id"])


def _detected(texts: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names``, text, base and every."""
    docs = texts
    start, trees, (a, b), bars, _ = model(docs.sparkSession)
    limits = F.array(*map(F.lit, bars))

    def scored(c: Column) -> Column:
        features = [F.get(c.x, k) for k in range(len(FEATURES))]
        odds = a * (F.lit(start) + sum((tree_column(t, features) for t in trees[1:]), tree_column(trees[0], features))) + b
        return F.struct((1 / (1 + F.exp(-odds))).alias("p"), c.kind.alias("kind"), c.start.alias("start"), c.end.alias("end"))

    def every(base: Column) -> Column:
        cross = lambda s, o: (s.start < o.end) & (o.start < s.end)
        free = F.filter(proposals(F.col("text")), lambda c: ~F.exists(base, lambda s: cross(s, c)))
        good = F.filter(F.transform(free, scored), lambda c: c.p >= F.get(limits, c.kind))
        # Of candidates that cross, the likelier stays; then the longer, the earlier, and the earlier kind.  Equal ones are one.
        order = lambda c: F.struct(c.p, c.end - c.start, -c.start, -c.kind)
        best = _let(good, lambda g: F.filter(g, lambda c: ~F.exists(g, lambda o: cross(o, c) & (order(o) > order(c)))))
        added = F.array_distinct(F.transform(best, lambda c: F.struct(c.kind.alias("kind"), c.start.alias("start"), c.end.alias("end"))))
        return F.struct(base.alias("base"), F.when(F.size(added) > 0, F.array_sort(F.concat(base, added))).otherwise(base).alias("every"))

    # ``found`` is used twice below, so that the optimizer keeps it as a column of its own.
    found = texts.select(*names, "text", _let(base_spans(F.col("text")), every).alias("found"))
    return found.select(*names, "text", F.col("found.base").alias("base"), F.col("found.every").alias("every"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the number of base spans of each kind, the digest of the base spans, all spans, and their number."""
    found = detect(docs, id_col, text_col)
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.col("every")).alias("spans"), F.size("every").cast("long").alias("n_spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with every span of the text replaced by its kind in brackets, and spans.  A null text becomes empty."""
    names = [c for c in docs.columns if c.lower() != "spans"]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), whole(text_col).alias("text"))
    kinds = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    found = _detected(held, ["row"])
    ordered = F.array_sort(F.transform("every", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    put = F.aggregate(
        ordered,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s.start < acc["at"], acc).otherwise(
            F.struct(F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, s.start - acc["at"]), F.get(kinds, s.kind)).alias("done"), s.end.alias("at"))
        ),
        lambda acc: F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    text = F.when(F.size("every") > 0, put).otherwise(F.col("text"))
    return found.select(*[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in names], _named(F.col("every")).alias("spans"))
