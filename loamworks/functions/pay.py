"""Reading amounts of pay from free text."""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import types as T

# Currency of each market.
MARKET_CURRENCY = {"AU": "AUD", "NZ": "NZD", "SG": "SGD", "MY": "MYR", "HK": "HKD", "PH": "PHP", "ID": "IDR", "TH": "THB"}

# How a currency is written, the more specific first; a bare $ or "dollars" is the market's.
CURRENCY_FORMS = [
    ("AUD", r"au\$|aud\$?|a\$|australian dollars?"),
    ("NZD", r"nz\$|nzd\$?|new zealand dollars?"),
    ("USD", r"us\$|usd\$?|us dollars?|american dollars?"),
    ("SGD", r"sgd\$?|s\$|singapore dollars?"),
    ("HKD", r"hk\$|hkd\$?|hong kong dollars?"),
    ("GBP", r"£|gbp|pounds? sterling|pounds?|sterling"),
    ("EUR", r"€|eur|euros?"),
    ("MYR", r"myr|rm|ringgit"),
    ("PHP", r"₱|php|pesos?"),
    ("IDR", r"idr|rp\.?|rupiah"),
    ("THB", r"฿|thb|baht"),
]

# How a period is written.
PERIOD_FORMS = [
    ("fortnightly", r"(?:every )?two weeks|fortnight(?:ly)?|p\.?f\.?|f/n"),
    ("hourly", r"hours?|hourly|hr|p\.?h\.?|h|jam|per jam"),
    ("daily", r"days?|daily|p\.?d\.?|day[- ]rate|hari|working day"),
    ("weekly", r"weeks?|weekly|wk|p\.?w\.?|minggu"),
    ("monthly", r"months?|monthly|mth|p\.?m\.?|pcm|p\.c\.m\.?|bulan|sebulan|bln"),
    ("annual", r"years?|yearly|yr|annual(?:ly)?|annum|p\.?a\.?|tahun|setahun|thn"),
]

SCALES = {"k": 1_000, "thousand": 1_000, "ribu": 1_000, "rb": 1_000, "jt": 1_000_000, "juta": 1_000_000, "million": 1_000_000, "mio": 1_000_000, "mn": 1_000_000, "m": 1_000_000}

_edge = lambda forms: re.compile("|".join(f"(?P<{name}>(?<![a-z])(?:{form})(?![a-z$]))" for name, form in forms))
CURRENCY = _edge(CURRENCY_FORMS)
PERIOD = _edge(PERIOD_FORMS)
NO_AMOUNT = re.compile(
    r"\d+(?:[.,]\d+)?\s*(?:%|percent|per cent)"
    r"|\b(?:grade|level|band|step|scale|class)\s*\d+"
    r"|(?:\bfor\s+)?\d+(?:[.,]\d+)?\s*(?:-|–|to)?\s*(?:\d+\s*)?(?:hours|hrs|hour weeks?)\b(?:\s*(?:/|per|a|each|every)?\s*(?:week|wk|fortnight|weekly|month|day)\b|\s*p\.?w\.?)?"
    r"|\bsee\b.*\bguide\b|\b(?:19|20)\d\d pay guide\b"
    r"|\b\d+(?:st|nd|rd|th)\b|\b\d+\s*(?:weeks|days)\s*(?:leave|holiday)"
)
NUMBER = re.compile(r"(?<![\d.,])(\d{1,3}(?:(?:,\d{3})+|(?:\.\d{3})+|(?: \d{3})+)(?!\d)(?:[.,]\d{1,2}(?!\d))?|\d+(?:[.,]\d+)?)\s*(thousand|million|juta|ribu|mio|jt|rb|mn|k|m)?(?![a-z0-9])|(?<![\d.,])(\d+(?:[.,]\d+)?)")

PAY_WORD = r"\b(?:salary|salaries|pay|wages?|figures?|amounts?|sums?|rates?|remuneration|day-rate|gaji)\b"
PAY = re.compile(PAY_WORD, re.I)
THOUSANDS = re.compile(r"\bthousands?\b", re.I)
MILLIONS = re.compile(r"\b(?:millions?|juta)\b", re.I)
SAYS_CURRENCY = re.compile(r"\b(?:pay|salary|salaries|quoted|stated|amounts?|figures?|wages?|sums?|rates?)\b.*\bin\b", re.I)

PARSED = T.StructType(
    [
        T.StructField("amount_min", T.DecimalType(14, 3)),
        T.StructField("amount_max", T.DecimalType(14, 3)),
        T.StructField("currency", T.StringType()),
        T.StructField("period", T.StringType()),
    ]
)


def _value(text: str) -> float:
    """A number whose separators may be blanks, commas or points."""
    text = text.replace(" ", "")
    tail = re.search(r"[.,](\d+)$", text)
    if tail and (len(tail[1]) != 3 or text.startswith("0")):
        return float(re.sub(r"[.,]", "", text[: tail.start()]) + "." + tail[1])
    return float(re.sub(r"[.,]", "", text))


def _pay_sentences(text: str) -> Iterator[str]:
    """The sentences of ``text`` that speak of pay, in lower case."""
    at = 0
    while m := PAY.search(text, at):
        start = max(text.rfind(c, 0, m.start()) for c in ".!?\n") + 1
        ends = [e for c in ".!?\n" if (e := text.find(c, m.end())) >= 0]
        at = min(ends, default=len(text))
        yield text[start:at].lower()


def parse_pay(raw: str | None, description: str | None, market: str | None) -> tuple | None:
    """``(amount_min, amount_max, currency, period)``, or None if ``raw`` states no amount.

    What ``raw`` leaves open (period, currency, scale) is looked up in those
    sentences of ``description`` that speak of pay; a period stated nowhere is
    annual, a currency stated nowhere that of ``market`` (AUD for an unknown one).
    """
    if not raw:
        return None
    s = " ".join(raw.lower().split())
    rest = NO_AMOUNT.sub(" ", s)
    found = []
    for m in NUMBER.finditer(rest):
        digits = m[1] or m[3]
        scale = SCALES.get(m[2] or "", 1)
        value = _value(digits)
        # before a scale word, a lone separator is a decimal one: 6,8 jt
        if scale > 1 and re.fullmatch(r"\d+[.,]\d{1,2}", digits):
            value = float(digits.replace(",", "."))
        found.append((value, scale))
        if len(found) == 2:
            break
    if not found:
        return None
    currency = next((m.lastgroup for m in CURRENCY.finditer(re.sub(r"\d", " ", rest))), None)
    periods = [m.lastgroup for m in PERIOD.finditer(re.sub(r"\d", " ", rest))]
    period = periods[0] if periods else None
    scaled = [c for _, c in found if c > 1]
    if scaled and len(found) == 2:
        found = [(v, c if c > 1 or v >= 1000 else scaled[0]) for v, c in found]
    if description and (period is None or currency is None or not scaled):
        for sentence in _pay_sentences(description):
            if not scaled and max(v for v, _ in found) < 1000 and len(sentence) < 120:
                if THOUSANDS.search(sentence):
                    found = [(v, 1_000) for v, _ in found]
                elif MILLIONS.search(sentence):
                    found = [(v, 1_000_000) for v, _ in found]
            if currency is None and SAYS_CURRENCY.search(sentence) and (c := CURRENCY.search(sentence)):
                currency = c.lastgroup
            if period is None and len(sentence) < 120:
                period = next((p.lastgroup for p in PERIOD.finditer(sentence, PAY.search(sentence).start()) if p[0] not in ("h", "pm", "pa", "pf")), None)
    amounts = [round(v * c, 3) for v, c in found]
    return min(amounts), max(amounts), currency or MARKET_CURRENCY.get(market or "", "AUD"), period or "annual"


def parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For ``mapInPandas`` over (job_id, salary_raw, description, market_code)."""
    from decimal import Decimal

    for pdf in batches:
        rows = [
            (i, Decimal(f"{p[0]:.3f}"), Decimal(f"{p[1]:.3f}"), p[2], p[3])
            for i, raw, d, m in zip(pdf.job_id, pdf.salary_raw, pdf.description, pdf.market_code, strict=True)
            if (p := parse_pay(raw, d, m))
        ]
        yield pd.DataFrame(rows, columns=["job_id", "amount_min", "amount_max", "currency", "period"])
