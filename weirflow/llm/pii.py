"""Personal data and secrets: fixed patterns, and candidates chosen by gradient-boosted trees. DataFrame functions only.

Fixed patterns give the base spans (email, ip, card, phone), which always stay. High-recall generators then
propose overlapping spans: the same kinds in looser formats, and secrets (passwords, tokens, keys), for which there is no fixed
pattern. Boosted trees score each from its format and its context, and a threshold for each kind, calibrated for precision,
selects. The trees are fitted on the driver on ``TRAINING`` generated sentences whose features the same column expressions
compute, and run as one SQL expression. Sentences put cue words before what is personal, before what is not, and leave them out,
in words that the features' lists know and words that they do not; thresholds are set on sentences whose cue words the fit has
not seen.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm._shared import apart, picked, place, renamed

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
#: Kinds of candidates.
EVERY = (*KINDS, SECRET)

# The base patterns, written so that a search takes time in proportion to the text and no deep recursion: matches start where a
# run starts (or where the last match ended), runs are possessive, and a card run is taken only if it has 13 to 19 digits.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# The generators.
_LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]{0,63} ?(?:@|[(\[{<] ?at ?[)\]}>]| at ) ?[a-z0-9-]{1,63}(?: ?(?:[(\[{<] ?dot ?[)\]}>]| dot ) ?[a-z0-9-]{2,63}|\.[a-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\.|[(\[] ?(?:dot|\.) ?[)\]]) ?[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{4,6}){2,3}(?:[\x20._/-]{1,2}[0-9]{1,3})?(?![0-9])",
    "phone": r"(?<![0-9+.])(?:\(?(?:00|0)[0-9]{1,4}\)?[\x20./-]{1,2}|\([0-9]{2,5}\)[\x20./-]{0,2}|[0-9]{2,4}[\x20./-]{1,2})[0-9]{2,4}(?:[\x20./-]{1,2}[0-9]{2,5}){1,3}(?![0-9])",
    "secret": r"(?<=(?i:pass(?:word|wort|wd|code|phrase)?|pwd|secret|token|key|contraseña|mot de passe)[\"']?\x20?[=:]\x20?[\"']?)[^\s\"',;<>]{6,200}+|(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]*+[0-9])[A-Za-z0-9+/_.-]{16,400}+={0,2}+",
}
_GATE = {"email": r"(?i)[(\[{<] ?at ?[)\]}>]|(?i) dot |@", "ip": r"[0-9] ?[.(\[]", "card": r"[0-9]{4}[\x20._/-]", "phone": r"[0-9]{2}[)\x20./-]", "secret": r"(?i)pass|pwd|secret|token|key|contrase|(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]*+[0-9])[A-Za-z0-9+/_.-]{16}"}

FEATURES = ("kind", "length", "digits", "separators", "luhn", "brackets", "small", "said", "other", "before", "after", "date", "groups", "upper", "distinct", "hex", "prefix", "assigned", "slashes", "tld")
TRAINING = 4000
_ROUNDS, _RATE, _DEPTH = 30, 0.3, 3
PRECISION = 0.98


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _located(text: Column, pattern: str) -> Column:
    """All matches as structs of s, e (code points, end exclusive) and t, in order.

    The pieces between matches tell where these lie; running sums go over blocks, so many matches stay cheap.
    """
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")
    block = 256

    def place(m: Column, p: Column) -> Column:
        n = F.size(m)
        return _let(
            F.transform(m, lambda x, i: F.length(F.get(p, i)) + F.length(x)),
            lambda step: _let(
                F.aggregate(
                    F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.aggregate(F.slice(step, b * block + 1, block), F.lit(0), lambda a, x: a + x)),
                    F.array(F.lit(0)),
                    lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)),
                ),
                lambda offs: F.transform(
                    m,
                    lambda x, i: _let(
                        F.get(offs, F.floor(i / block).cast("int")) + F.aggregate(F.slice(step, F.floor(i / block).cast("int") * block + 1, i % block), F.lit(0), lambda a, y: a + y) + F.length(F.get(p, i)),
                        lambda s: F.struct(s.alias("s"), (s + F.length(x)).alias("e"), x.alias("t")),
                    ),
                ),
            ),
        )

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, _let(F.split(text, pattern, -1), lambda p: place(m, p))).otherwise(none))


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(t: Column) -> Column:
    return _let(
        F.reverse(_digits(t)),
        lambda d: F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))),
            F.lit(0),
            lambda a, i: a + _let(F.coalesce(F.substring(d, i, F.lit(1)).try_cast("int"), F.lit(0)) * (2 - i % 2), lambda v: v - F.when(v > 9, 9).otherwise(0)),
        )
        % 10
        == 0,
    )


def base_spans(text: Column) -> dict[str, Column]:
    """The fixed patterns' spans of each kind; a null text has none."""
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")
    gated = {
        "email": F.when(F.contains(text, F.lit("@")), _located(text, _EMAIL)),
        "ip": F.when(F.rlike(text, F.lit(r"[0-9]\.[0-9]")), F.filter(_located(text, _IP), lambda x: F.forall(F.split(x["t"], r"\."), lambda v: F.length(F.ltrim(v, F.lit("0"))) <= 3) & F.forall(F.split(x["t"], r"\."), lambda v: F.coalesce(F.when(F.length(F.ltrim(v, F.lit("0"))) <= 3, F.concat(F.lit("0"), F.substring(F.ltrim(v, F.lit("0")), 1, 3)).try_cast("int")), F.lit(999)) <= 255))),
        "card": F.when(F.rlike(text, F.lit(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]")), F.filter(_located(text, _CARD), lambda x: _luhn(x["t"]))),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(_located(text, _PHONE), lambda x: F.length(_digits(x["t"])).between(9, 15))),
    }
    return {k: F.coalesce(v, none) for k, v in gated.items()}


_SAID = {
    "email": r"(?:mail|contact|write|reach|schreib|escrib|écri)",
    "ip": r"(?:\bip\b|host|server|address|addr|login from|adresse)",
    "card": r"(?:card|visa|master|amex|payment|karte|tarjeta|carte)",
    "phone": r"(?:tel|phone|call|fax|mobile|cell|dial|sms|whatsapp|ruf|llam|appel)",
    "secret": r"(?:pass(?:word|wort|wd|code|phrase)?|pwd|secret|token|api[_ -]?key|key|auth|bearer|credential|contraseña|mot de passe)[^a-z0-9]{0,6}$",
}
_NOT = r"(?:isbn|order|invoice|version|release|build|section|page|date|serial|sku|ref|no\.|#|\$|€|ratio|score|total|commit|sha|md5|hash|checksum|uuid|guid|base64|file|path|url|http|issue|doi|img)"
_PREFIX = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_|^sk[_-]|^pk_live|^xox[abp]-|^AIza|^eyJ[A-Za-z0-9_-]+[.]eyJ|^glpat-|^npm_"


def _features(kind: str, x: Column, left: Column, right: Column) -> list[Column]:
    t = x["t"]
    d = _digits(t)
    small = F.forall(F.split(F.regexp_replace(t, "[^0-9]+", "."), r"\."), lambda v: F.coalesce(F.substring(v, 1, 4).try_cast("int"), F.lit(0)) <= 255)
    return [
        F.lit(EVERY.index(kind)),
        F.length(t),
        F.length(d),
        F.length(F.regexp_replace(t, r"[^\x20./_-]", "")),
        (F.length(d) >= 13) & _luhn(t),
        F.rlike(t, F.lit(r"[(\[{<]")),
        small,
        F.rlike(left, F.lit(_SAID[kind])),
        F.rlike(left, F.lit(_NOT)),
        F.rlike(left, F.lit(r"[a-z0-9$€#.,:/_-]$")),
        F.rlike(right, F.lit(r"^[A-Za-z0-9%_/]|^[.,:-][0-9]")),
        F.rlike(t, F.lit(r"^(?:(?:19|20)[0-9]{2}[\x20./-][0-9]{1,2}[\x20./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2})")),
        F.size(F.split(F.regexp_replace(t, r"^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", ""), "[^0-9A-Za-z]+")),
        F.length(F.regexp_replace(t, "[^A-Z]", "")),
        F.size(F.array_distinct(F.split(F.substring(t, 1, 64), ""))),
        F.rlike(t, F.lit(r"^[0-9a-f]+$|^[0-9A-F]+$")),
        F.rlike(t, F.lit(_PREFIX)),
        F.rlike(left, F.lit(r"""[=:] ?["']?$""")),
        F.length(F.regexp_replace(t, "[^/.]", "")),
        F.rlike(t, F.lit(r"(?i)(?:com|org|net|edu|gov|info|io|co|eu|de|fr|es|it|nl|ch|uk|us)$")),
    ]


def candidates(text: Column) -> Column:
    """Proposed spans as structs of k (kind's place), s, e and f (features), over all generators; spans may overlap."""
    none = F.array().cast("array<struct<k:int,s:int,e:int,f:array<int>>>")

    def of(kind: str) -> Column:
        def one(x: Column) -> Column:
            left = F.lower(F.substring(text, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24))))
            right = F.substring(text, x["e"] + 1, F.lit(2))
            return F.struct(F.lit(EVERY.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.array(*[c.cast("int") for c in _features(kind, x, left, right)]).alias("f"))

        return F.coalesce(F.when(F.rlike(text, F.lit(_GATE[kind])), F.transform(_located(text, _LOOSE[kind]), one)), none)

    return F.concat(*[of(k) for k in EVERY])


# ---- the trees -------------------------------------------------------------------------------------------------------


@dataclass
class Boosted:
    """Trees: (feature, bound, left, right), where left and right are trees or leaf values; and the summed score from which a candidate is chosen."""

    start: float = 0.0
    trees: list = field(default_factory=list)
    bound: float = 1e9

    def column(self, f: Column) -> Column:
        def of(t) -> Column:
            return F.lit(float(t)) if isinstance(t, float) else F.when(F.get(f, F.lit(t[0])) <= t[1], of(t[2])).otherwise(of(t[3]))

        out = F.lit(self.start)
        for t in self.trees:
            out = out + of(t)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        def of(t, at: np.ndarray) -> np.ndarray:
            return np.full(len(at), t) if isinstance(t, float) else np.where(x[at, t[0]] <= t[1], of(t[2], at), of(t[3], at))

        return self.start + sum(of(t, np.arange(len(x))) for t in self.trees)


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Gradient boosting of the logistic loss with Newton leaves."""
    m = Boosted(float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
    score = np.full(len(y), m.start)

    def tree(at: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        leaf = float(np.clip(_RATE * g[at].sum() / (h[at].sum() + 1.0), -2, 2))
        if not depth:
            return leaf
        best, cut = 1e-6 + g[at].sum() ** 2 / (h[at].sum() + 1.0), None
        for j in range(x.shape[1]):
            for b in np.unique(x[at, j])[:-1].tolist():
                low = x[at, j] <= b
                gl, hl, gr, hr = g[at][low].sum(), h[at][low].sum(), g[at][~low].sum(), h[at][~low].sum()
                if min(low.sum(), (~low).sum()) >= 5 and (gain := gl * gl / (hl + 1.0) + gr * gr / (hr + 1.0)) > best:
                    best, cut = gain, (j, b)
        if cut is None:
            return leaf
        low = x[at, cut[0]] <= cut[1]
        return (cut[0], int(cut[1]), tree(at[low], g, h, depth - 1), tree(at[~low], g, h, depth - 1))

    for _ in range(_ROUNDS):
        p = 1 / (1 + np.exp(-score))
        m.trees.append(tree(np.arange(len(y)), y - p, p * (1 - p), _DEPTH))
        score = m.scores(x)
    return m


#: Cue words by kind, in the order fit, calibration, fit, ...; half of them stand in no list of the features. ``none``: before numbers and names of all sorts.
_CUES = {
    "email": ["mail", "reach us under", "contact", "please drop a line to", "write to", "inquiries:", "schreib an", "für Fragen"],
    "ip": ["host", "blocked", "server", "the request came from", "login from", "address", "IP", "machine"],
    "card": ["card", "he paid by", "visa", "charge it to", "Karte", "plastic no", "charged:", "payment of"],
    "phone": ["call", "under the number", "tel:", "ring me:", "mobile", "fax", "Rückfragen", "cell"],
    "secret": ["password=", 'token = "', "secret: ", "api_key=", "pwd=", "auth token: ", 'key="', "passwort: "],
    "none": ["isbn", "article", "order", "lot", "invoice", "Bestellung", "version", "table", "page", "result", "serial", "item", "ref", "am", "total", "set", "score", "between", "", "", "and", "the"],
}
_PLAIN = "the of and for with this that from they said after when over into das und nicht eine wurde sich les des une dans pour que con los para una été more than some first last".split()


def _sentences(n: int, seed: int = 5) -> list[tuple[str, int]]:
    """Generated sentences with one span each, and its kind's place in ``EVERY``, or -1; those at odd places have cue words of their own."""
    r = random.Random(seed)
    letters, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"

    def d(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def of(chars: str, k: int) -> str:
        return "".join(r.choice(chars) for _ in range(k))

    def luhn(k: int) -> str:
        body = r.choice("3456") + d(k - 2)
        s = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(body)))
        return body + str(-s % 10)

    def word() -> str:
        return r.choice(_PLAIN) if r.random() < 0.6 else of(letters, r.randint(2, 9))

    def name() -> str:
        return of(letters, r.randint(3, 9))

    def grouped(x: str, sep: str) -> str:
        return sep.join(x[i : i + 4] for i in range(0, len(x), 4))

    def octets(sep: str, top: int = 255) -> str:
        return sep.join(str(r.randint(0 if top < 256 else 300, top)) for _ in range(4))

    def cue(kind: str, odd: int) -> str:
        return r.choice(_CUES[kind][odd::2])

    sep = lambda: r.choice([" ", "-", ".", "/"])
    strong = letters + letters.upper() + "0123456789"
    good = [
        ("phone", [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"00{d(2)} {d(3)} {d(3)} {d(3)}", lambda: f"({d(4)}) {d(3)} {d(3)}", lambda: f"0{d(3)}/{d(3)} {d(3)}"]),
        ("card", [lambda: grouped(luhn(16), "."), lambda: grouped(luhn(16), "  "), lambda: grouped(luhn(16), "/"), lambda: grouped(luhn(16), "_")]),
        ("email", [lambda: f"{name()}(at){name()}.com", lambda: f"{name()} [at] {name()} [dot] org", lambda: f"{name()} (at) {name()} (dot) net", lambda: f"{name()}[at]{name()}[dot]de"]),
        ("email", [lambda: f"{name()} at {name()} dot com", lambda: f"{name()}{d(2)} at {name()} dot org"]),
        ("ip", [lambda: octets("[.]"), lambda: octets(" . "), lambda: octets("(dot)"), lambda: octets(" [.] ")]),
        ("secret", [lambda: of(hexes, r.choice([18, 24, 40])), lambda: of(hexes, r.choice([20, 32, 64])), lambda: of(strong, r.randint(16, 44)), lambda: of(strong + "+/", r.randint(20, 48)) + "="]),
        ("secret", [lambda: of(letters, 5) + d(2) + r.choice("!#%&") + of(strong, 3), lambda: of(strong + "!$%", r.randint(8, 14)) + d(1)]),
        ("free", [lambda: r.choice(["AKIA", "ASIA"]) + of(letters.upper() + "234567", 16), lambda: r.choice(["ghp_", "gho_"]) + of(strong, 36), lambda: "sk_live_" + of(strong, 24), lambda: f"eyJ{of(strong, 18)}.eyJ{of(strong, 30)}.{of(strong, 22)}", lambda: "AKIA" + of(letters.upper() + "0123456789", 16), lambda: f"xoxb-{d(11)}-{of(strong, 24)}"]),
    ]
    bad = [
        ("none", [lambda: sep().join([d(3), d(3), d(4)]), lambda: sep().join([d(2), d(3), d(3)])]),
        ("none", [lambda: s.join([r.choice(["19", "20"]) + d(2), d(2), d(2)]) if (s := sep()) else "", lambda: s.join([d(2), d(2), r.choice(["19", "20"]) + d(2)]) if (s := sep()) else ""]),
        ("none", [lambda: " ".join(d(r.randint(2, 4)) for _ in range(r.randint(3, 5))), lambda: ".".join(d(r.randint(2, 3)) for _ in range(3))]),
        ("none", [lambda: grouped(d(15) + str((int(luhn(16)[-1]) + 3) % 10), r.choice([".", "/"])), lambda: grouped(d(16), r.choice([" ", "-"]))]),
        ("none", [lambda: f"{word()} at {word()}.{word()}", lambda: f"{word()} at {word()} dot {word()}"]),
        ("none", [lambda: octets(r.choice([" . ", ". "]), 999), lambda: octets(". ", r.choice([255, 999]))]),
        ("call", [lambda: s.join([r.choice(["19", "20"]) + d(2), d(2), d(2)]) if (s := sep()) else "", lambda: sep().join([d(2), d(2), d(2)])]),
        ("hash", [lambda: of(hexes, 40), lambda: of(hexes, r.choice([32, 64])), lambda: f"{of(hexes, 8)}-{of(hexes, 4)}-4{of(hexes, 3)}-a{of(hexes, 3)}-{of(hexes, 12)}"]),
        ("link", [lambda: f"{name()}.com/{name()}/{d(4)}/{name()}-{d(3)}.html", lambda: f"/{name()}/{name()}{d(2)}/{name()}.{d(1)}.txt", lambda: f"IMG_{d(8)}_{d(6)}.jpg", lambda: f"{name()}-{d(1)}.{d(2)}.{d(1)}-{name()}.tar"]),
        ("none", [lambda: f"{name().upper()}_{name().upper()}_{d(2)}", lambda: f"{name()}{d(2)}{name()}{name()}", lambda: f"{name()}-{d(4)}-{name()}-{name()}", lambda: "=" * r.randint(10, 30) + d(2) + "=" * 9, lambda: d(r.randint(16, 24)), lambda: f"{d(4)}-{d(2)}-{d(2)}T{d(2)}.{d(2)}.{d(2)}Z", lambda: f"{d(3)}.{d(5)}/{d(4)}-{d(4)}.{d(2)}"]),
    ]
    special = {
        "free": lambda odd: r.choice([word(), word(), "key:", "id"]),
        "call": lambda odd: r.choice([["call on", "phone on"], ["mobile since", "ring after"]][odd]),
        "hash": lambda odd: r.choice([["commit", "sha256", "md5:"], ["checksum", "uuid", "revision"]][odd]),
        "link": lambda odd: r.choice([["http://www.", "see ", "file "], ["https://", "in ", "at "]][odd]),
    }
    out = []
    for i in range(n):
        y, odd = r.randint(0, 1), i % 2
        kind, forms = r.choice(good if y else bad)
        core = r.choice(forms)()
        if kind in special:
            before = special[kind](odd)
        elif kind in ("card", "phone", "ip") and r.random() < 0.25 and y:
            before = word()  # its form alone says it
        else:
            before = cue(kind, odd)
        glue = "" if kind == "secret" or before.endswith((".", " ", "/")) else " "
        true = -1 if not y else EVERY.index(SECRET if kind == "free" else kind)
        out.append((f"{word()} {word()} {before}{glue}{core}{r.choice([' ', '. ', ', ', chr(34) + ' '])}{word()}", true))
    return out


_fitted: dict[int, list[Boosted]] = {}


def _scored(spark: SparkSession, sentences: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sentences' candidates: which sentence, whether it is personal as what it is proposed for, features."""
    rows = [{"i": i, "t": t, "y": y} for i, (t, y) in enumerate(sentences)]
    frame = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<i:int,t:string,y:int>>")).alias("r")).select("r.*")
    got = frame.select("i", "y", F.explode(candidates(F.col("t"))).alias("c")).select("i", (F.col("y") == F.col("c.k")).alias("y"), "c.f").collect()
    return np.array([r.i for r in got], np.int64), np.array([r.y for r in got], float), np.array([r.f for r in got]).reshape(-1, len(FEATURES))


def model(spark: SparkSession, n: int = TRAINING) -> list[Boosted]:
    """One set of trees for each kind, fitted on every second generated sentence; the others set its threshold, the lowest score with precision ``PRECISION``."""
    if n not in _fitted:
        i, y, x = _scored(spark, _sentences(n))
        out = []
        for kind in range(len(EVERY)):
            fit, own = np.flatnonzero((x[:, 0] == kind) & (i % 2 == 0)), np.flatnonzero((x[:, 0] == kind) & (i % 2 == 1))
            m = boost(x[fit], y[fit])
            score = m.scores(x[own])
            order = np.argsort(-score, kind="stable")
            right = np.cumsum(y[own][order]) / np.arange(1, len(own) + 1)
            ok = np.flatnonzero(right >= PRECISION)
            m.bound = float(max(score[order[ok[-1]]], 0.5)) if len(ok) else 1e9
            out.append(m)
        _fitted[n] = out
    return _fitted[n]


def accepted(models: list[Boosted], c: Column) -> Column:
    """Whether the trees of its kind choose a candidate."""
    out = F.lit(False)
    for k, m in enumerate(models):
        out = F.when(c["k"] == k, m.column(c["f"]) >= m.bound).otherwise(out)
    return out


def _all_base() -> Column:
    def of(i: int) -> Column:
        return F.transform(KINDS[i], lambda x: F.struct(F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e")))

    return F.concat(*[of(i) for i in range(len(KINDS))])


def _found(docs: DataFrame, text_col: str) -> tuple[DataFrame, list[str]]:
    """The documents with columns c0, c1, ... by place, one array of base spans for each kind, and all spans, secrets too, in ``spans``."""
    m = model(docs.sparkSession)
    base, inner = renamed(docs)
    text = F.col(inner[place(docs, text_col)]).cast("string")
    out = base.select(*inner, *[v.alias(k) for k, v in base_spans(text).items()]).withColumn("base", _all_base())
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")

    def chosen(c: Column) -> Column:
        return accepted(m, c) & ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))

    picked = F.transform(F.filter(candidates(text), chosen), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k")))
    apart = F.aggregate(
        F.array_sort(picked),
        none,
        lambda a, c: F.when((F.size(a) == 0) | (F.element_at(a, -1)["e"] <= c["s"]), F.concat(a, F.array(F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"))))).otherwise(a),
    )
    return out.withColumn("spans", F.array_sort(F.concat("base", F.coalesce(F.when(text.isNotNull(), apart), none)))).drop("base"), inner


#: Columns that ``personal_spans`` adds.
FOUND = (*(f"__wf_{k}" for k in KINDS), "__wf_spans")


def personal_spans(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents with ``__wf_<kind>`` (base spans: s, e, t) for each kind and ``__wf_spans``: all spans as structs of k (place in ``EVERY``), s, e, sorted.

    Null and empty texts have none. A chosen candidate neither touches a base span nor overlaps another chosen one (the
    earlier start goes first). Rows are worked off where they lie; all columns stay, one that has the name of an added column
    gets an underscore behind its own; an empty table gives an empty result.
    """
    found, _ = _found(docs, text_col)
    return found.toDF(*apart(docs.columns, FOUND), *FOUND)


def joined(spans: Column) -> Column:
    """kind:start:end of spans with k, s, e, joined with commas."""
    names = F.array(*map(F.lit, EVERY))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def span_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the number of base spans of each kind, base_sha256 (of the base spans, joined), spans (all spans of these kinds, joined), and n_spans, n_secret, secrets (joined likewise) and personal (whether there are spans or secrets)."""
    found, _ = _found(picked(docs, doc_id=id_col, text=text_col), "text")
    base, secret = _all_base(), EVERY.index(SECRET)
    spans, secrets = (F.filter("spans", f) for f in (lambda x: x["k"] != secret, lambda x: x["k"] == secret))
    return found.select(
        F.col("c0").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"),
        F.size(spans).cast("long").alias("n_spans"), F.size(secrets).cast("long").alias("n_secret"), joined(secrets).alias("secrets"), (F.size("spans") > 0).alias("personal"),
    )


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; where spans overlap, the first by start stands for them."""
    found, inner = _found(docs, text_col)
    names, t = F.array(*map(F.lit, EVERY)), inner[place(docs, text_col)]
    text = F.col(t)
    flat = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    step = F.aggregate(
        flat,
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at")),
        lambda a, x: F.when(x["s"] >= a["at"], F.struct(F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.concat(F.lit("["), F.element_at(names, x["k"] + 1), F.lit("]")))).alias("out"), x["e"].alias("at")))
        .otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], x["e"]).alias("at"))),
        lambda a: F.concat(F.concat_ws("", a["out"]), F.substring(text, a["at"] + 1, F.length(text))),
    )
    return found.select(*[(F.when(F.size("spans") > 0, step).otherwise(text).alias(c) if c == t else F.col(c)) for c in inner]).toDF(*docs.columns)
