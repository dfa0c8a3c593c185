"""Personal data by weak supervision.

Four base kinds are found by fixed patterns and always stay. Looser patterns propose more spans. On every
candidate, base ones included, labelers vote for, against or not at all: the strict pattern, a checksum, a
gazetteer (domains, card issuers, calling codes, prefixes of keys), the words around the span, and what
stands at its edges. Expectation maximisation over the counts of vote patterns of the whole corpus
estimates each labeler's reliability for each kind without labels; its posteriors then train a logistic
classifier on votes, length and share of digits, which decides about the candidates beyond the base.

Counts of vote patterns are a table of fixed size, whatever the corpus. Detection runs once to count and
once to apply; no text is shuffled.

Defined results: a null or empty text has no spans; overlapping candidates yield to base spans and then to
the earlier and longer one; without any candidate the classifier accepts nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Kinds in their listed order; the last one has no base pattern.
KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
VOTES = ("strict", "checksum", "gazetteer", "context", "shape")
#: Top-level domains, prefixes of card issuers, calling codes of countries and prefixes of keys.
DOMAINS = frozenset(
    "com org net edu gov mil int info biz name pro coop museum aero jobs mobi travel tel asia cat xxx post app dev io ai co me tv cc ws "
    "ac ad ae af ag al am ao ar at au az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cd cf cg ch ci ck cl cm cn cr cu cv cy cz "
    "de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gh gi gl gm gn gp gq gr gt gu gy hk hn hr ht hu id ie il im in iq ir is it "
    "je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md mg mh mk ml mm mn mo mr mt mu mv mw mx my mz "
    "na nc ne ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg si sk sl sm sn so sr st sv sy sz "
    "td tg th tj tk tl tm tn to tr tt tw tz ua ug uk us uy uz va vc ve vg vi vn vu ye za zm zw example test".split()
)
ISSUERS = ("4", "34", "37", "35", "36", "38", "50", "51", "52", "53", "54", "55", "56", "57", "58", "6011", "62", "63", "64", "65", "67", "2221", "23", "24", "25", "26", "270")
CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "94", "98", "212", "213", "234", "254", "351", "352", "353", "358", "359", "370", "371", "372", "380", "385", "386", "420", "421", "852", "880", "886", "966", "971", "972")
KEYS = ("sk-", "sk_", "pk_", "rk_", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "AKIA", "ASIA", "AIza", "ya29", "eyJ", "npm_", "pypi-", "hf_", "SG_", "key-", "tok_")
#: Words that go with a kind, before or behind it, and words that speak against personal data.
WORDS = {
    EMAIL: frozenset("mail email e-mail contact contacto kontakt courriel correo schreiben escribe écrire address adresse dirección".split()),
    IP: frozenset("ip ipv4 host server address addr client login proxy gateway subnet ping dns adresse dirección serveur servidor".split()),
    CARD: frozenset("card visa mastercard amex credit debit karte carte tarjeta payment pay kreditkarte paiement pago crédito cvv".split()),
    PHONE: frozenset("phone tel telephone call mobile cell fax telefon téléphone teléfono handy appelez llame anrufen whatsapp sms".split()),
    SECRET: frozenset("token key secret password passwd pwd apikey api_key access_key private bearer auth authorization credential schlüssel clé clave contraseña".split()),
}
AGAINST = frozenset("version release section isbn issn doi page figure table license chapter § sha sha1 sha256 md5 hash commit checksum uuid".split())
SHARES = 3

_email_tail = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_email_head = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_masked_tail = re.compile(r" ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]++)+")
_loose_phone = re.compile(r"(?<![0-9+(])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
_secret = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+")
_digit = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _head(text: str, at: int, end: int) -> int:
    """Where the local part before ``at`` begins, not before ``end``; ``at`` if there is none."""
    start, step = at, 64
    while start > end:
        lo = max(end, start - step)
        m = _email_head.search(text, lo, start)
        if not m:
            break
        start = m.start()
        if start > lo:
            break
        step *= 2
    return start


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each begins where the characters before its @ do, or the last match ended."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = _head(text, at, end)
        m = _email_tail.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def masked_emails(text: str) -> list[tuple[int, int]]:
    """Addresses whose @ is written out, with their whole local part."""
    out, end = [], 0
    for m in _masked_tail.finditer(text):
        start = _head(text, m.start(), end)
        if start < m.start():
            end = m.end()
            out.append((start, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    out = [(s, EMAIL, e) for s, e in emails(text)] if "@" in text else []
    if _digit.search(text):
        out += [(m.start(), IP, m.end()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        out += [(m.start(), CARD, m.end()) for m in _card.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), PHONE, m.end()) for m in _phone.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of looser patterns."""
    out = []
    if "(at)" in text or "[at]" in text:
        out += [(s, EMAIL, e) for s, e in masked_emails(text)]
    if _digit.search(text):
        out += [(m.start(), IP, m.end()) for m in _ip.finditer(text)]
        out += [(m.start(), CARD, m.end()) for m in _card.finditer(text) if 13 <= len(_digits(m[0])) <= 19]
        out += [(m.start(), PHONE, m.end()) for m in _loose_phone.finditer(text)]
        out += [(m.start(), SECRET, m.end()) for m in _secret.finditer(text) if len(_digits(m[0])) >= 4 and re.search("[A-Za-z]", m[0])]
    return out


def _ballot(text: str, start: int, kind: int, end: int, base: bool) -> tuple[int, ...]:
    """Votes (1, 0 or -1) of the labelers on a span."""
    span, digits = text[start:end], _digits(text[start:end])
    near = re.split(r"[^\w@§-]+", text[max(0, start - 40) : start].lower())[-5:]
    after = re.split(r"[^\w@§-]+", text[end : end + 24].lower())[:3]
    if kind == EMAIL:
        ending = re.split(r"[.\])]\s?", span)[-1].lower()
        check, listed = (1 if ending.isalpha() and len(ending) >= 2 else -1), ending in DOMAINS
    elif kind == IP:
        octets = span.split(".")
        check, listed = (1 if all(len(p) <= 3 and int(p) <= 255 and (p == "0" or p[0] != "0") for p in octets) else -1), octets[0] not in ("0", "1", "2", "3")
    elif kind == CARD:
        check, listed = (1 if luhn(digits) else -1), digits.startswith(ISSUERS)
    elif kind == PHONE:
        check, listed = (1 if 9 <= len(digits) <= 15 else -1), digits.startswith(CALLING) if "+" in span else None
    else:
        check, listed = (1 if len(set(span)) >= 10 else -1), True if span.startswith(KEYS) else None
    known = WORDS[kind]
    context = -1 if AGAINST & set(near) else 1 if known & set(near) or known & set(after) else 0
    tight = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    shape = (1 if tight else -1) if kind != PHONE else (1 if tight and ("(" in span or span.count("-") + span.count(" ") <= 4) else -1)
    return (1 if base else 0 if kind == SECRET else -1, check, 0 if listed is None else 1 if listed else -1, context, shape)


def pattern_of(kind: int, votes: tuple[int, ...], span: str, base: bool) -> int:
    """One number for kind, votes, length class, share of digits and whether the span is a base one."""
    code = kind
    for v in votes:
        code = code * 3 + v + 1
    share = min(SHARES - 1, SHARES * len(_digits(span)) // len(span))
    return ((code * SHARES + share) * 4 + min(3, len(span) // 12)) * 2 + base


def parts_of(pattern: int) -> tuple[int, tuple[int, ...], int, int, bool]:
    """Kind, votes, length class, share of digits, base."""
    code, base = divmod(pattern, 2)
    code, size = divmod(code, 4)
    code, share = divmod(code, SHARES)
    votes = []
    for _ in VOTES:
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return code, tuple(reversed(votes)), size, share, bool(base)


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, pattern): base spans, and proposals that overlap none of them nor each other."""
    base = base_spans(text)
    out = [(s, k, e, pattern_of(k, _ballot(text, s, k, e, True), text[s:e], True)) for s, k, e in base]
    more = _proposals(text)
    if not more:
        return out
    taken = sorted((s, e) for s, _, e in base)
    at, last = 0, -1
    for s, k, e in sorted(more, key=lambda x: (x[0], -x[2], x[1])):
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if s < last or at < len(taken) and taken[at][0] < e:
            continue
        last = e
        out.append((s, k, e, pattern_of(k, _ballot(text, s, k, e, False), text[s:e], False)))
    return sorted(out)


def pattern_counts(docs: DataFrame, text_col: str = "text") -> Counter:
    """How often each vote pattern occurs, over all texts; at most a few thousand patterns exist."""

    def make():
        def step(ids: list, texts: list[str]) -> dict:
            seen = Counter(c[3] for t in texts for c in candidates(t))
            return {"pattern": list(seen), "n": list(seen.values())}

        return step

    rows = map_texts(docs, make, "pattern long, n long", text_col=text_col).groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return Counter({r["pattern"]: r["n"] for r in rows})


def reliabilities(ballots: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM for one kind: rates[c, labeler, vote + 1] of the classes c, and each ballot's posterior.

    It begins from labelers that are right three times as often as wrong, and smooths rates with one
    pseudo-vote of that belief, so that a class without votes keeps it.
    """
    believed = np.array([[0.45, 0.4, 0.15], [0.15, 0.4, 0.45]])
    rates = np.repeat(believed[:, None, :], ballots.shape[1], axis=1)
    share = 0.5
    votes = ballots[:, :, None] == np.array([-1, 0, 1])
    post = np.full(len(n), 0.5)
    for _ in range(rounds):
        logs = [np.log(p) + (votes * np.log(rates[c])).sum(axis=(1, 2)) for c, p in ((0, 1 - share), (1, share))]
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        for c, w in ((0, n * (1 - post)), (1, n * post)):
            rates[c] = ((votes * w[:, None, None]).sum(axis=0) + 3 * believed[c]) / (w.sum() + 3)
        share = float(np.clip((n * post).sum() / n.sum(), 0.02, 0.98))
    return rates, post


def accepted(counts: Counter, threshold: float = 0.5) -> tuple[frozenset[int], dict]:
    """Patterns beyond the base whose spans the final classifier takes, and what was estimated."""
    if not counts:
        return frozenset(), {}
    patterns = sorted(counts)
    split = [parts_of(p) for p in patterns]
    n = np.array([counts[p] for p in patterns], float)
    ballots = np.array([s[1] for s in split], float)
    kinds = np.array([s[0] for s in split])
    target, report = np.zeros(len(n)), {}
    for k in np.unique(kinds).tolist():
        own = kinds == k
        rates, target[own] = reliabilities(ballots[own], n[own])
        report[KINDS[k]] = rates
    sizes, shares = (np.array([s[k] for s in split]) for k in (2, 3))
    x = np.concatenate([ballots, ballots == 0, np.eye(len(KINDS))[kinds], np.eye(4)[sizes], np.eye(SHARES)[shares]], axis=1)
    weight, w = n / n.sum(), np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps of a ridge-penalised logistic fit
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    report["weights"] = w
    return frozenset(q for q, s, v in zip(patterns, split, p, strict=True) if not s[4] and v >= threshold), report


def find(docs: DataFrame, take: frozenset[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and spans (kind:start:end) of each whole text."""

    def make():
        def step(ids: list, texts: list[str]) -> dict:
            out: dict = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
            for t in texts:
                found = candidates(t)
                base = [c for c in found if c[3] & 1]
                for k, name in enumerate(KINDS[:4]):
                    out[f"n_{name}"].append(sum(c[1] == k for c in base))
                out["base_sha256"].append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base).encode()).hexdigest())
                out["spans"].append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, p in found if p & 1 or p in take))
            return {"doc_id": ids} | out

        return step

    return map_texts(docs, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", id_col, text_col)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts vote patterns over all texts, trains on them, and finds the spans."""
    return find(docs, accepted(pattern_counts(docs, text_col))[0], id_col, text_col)


def masked(text: str, take: frozenset[int]) -> str:
    """The text with [EMAIL] and the like in place of its spans; overlapping spans become one."""
    out, at = [], 0
    for s, k, e, p in candidates(text):
        if not (p & 1 or p in take):
            continue
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def mask_private(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with the spans in ``text`` masked; n_chars, where it exists, follows."""
    take = accepted(pattern_counts(docs.select(F.lit(0).alias("doc_id"), docs["text"])))[0]

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, take) for t in texts], dtype=object)

    cleaned = docs.withColumn("text", mask(docs["text"]))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return cleaned
