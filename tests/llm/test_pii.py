import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from originlake.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(len(x.lstrip("0")) > 3 or int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.+- ()é%5", max_size=60))
def test_base_spans_of_any_text(text):
    assert [s[:3] for s in pii.spans(text) if s[0] in pii.BASE] == base(text)


def test_query_against_patterns(docs, texts):
    got = sorted((r.asDict() for r in pii.pii_digest(docs).collect()), key=lambda r: (r["doc_id"], r["base_sha256"]))
    assert len(got) == len(texts)
    want = {i: base(t) for i, t in texts}
    for r in got:
        b = want[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest()
        for k in pii.BASE:
            assert r[f"n_{k}"] == sum(x[0] == k for x in b)
        own = [s for s in r["spans"].split(",") if s.split(":")[0] in pii.BASE]
        assert own == [f"{k}:{s}:{e}" for k, s, e in b]
    assert sum(r["n_card"] + r["n_email"] + r["n_ip"] + r["n_phone"] for r in got) > 8


def test_added_kinds_need_checks_and_context():
    kinds = [s[0] for s in pii.spans("IBAN GB82 WEST 1234 5698 7654 32 and ssn 123-45-6789")]
    assert kinds == ["iban", "ssn"]
    assert pii.spans("GB83 WEST 1234 5698 7654 32, part no 123-45-6789") == []


def test_redaction_and_empty(docs, empty):
    assert pii.redacted("to a@b.cd now") == "to [EMAIL] now"
    assert pii.redacted(None) is None
    out = pii.redact(docs.drop("length"))
    assert out.columns == docs.drop("length").columns
    assert out.where("text like '%example.org%'").count() == 0
    assert pii.pii_digest(empty).count() == 0


def test_account_numbers_end_where_their_check_holds():
    text = "IBAN GB82 WEST 1234 5698 7654 32 AND 12 DE89 3704 0044 0532 0130 00 ETC"
    assert [text[a:b] for k, a, b, _ in pii.spans(text) if k == "iban"] == ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"]
    assert [k for k, *_ in pii.spans("GB83 WEST 1234 5698 7654 32 AND") if k == "iban"] == []


def test_context_is_whole_words():
    kinds = lambda t: [s[0] for s in pii.spans(t)]
    for t in ("the hotel 555-123-4567", "basically 555.123.4567", "excellent 555-123-4567", "banker AT611904300234573201"):
        assert kinds(t) == [], t
    assert kinds("Call 555-123-4567") == kinds("phones: 555.123.4567") == kinds("555-123-4567 (fax)") == ["tel"]
    assert kinds("account AT611904300234573201") == kinds("AT61 1904 3002 3457 3201") == ["iban"]
    assert kinds("account ZZ611904300234573201") == kinds("account AT6119043002345732010") == []
