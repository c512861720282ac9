import hashlib
import re

from marginalia.llm.pii import find_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


CASES = [
    "mail a.b@c.de, x@y.z_q@r.st and ü@a.b; 1.2.3.4.5.6.7.8 256.1.1.1 01.002.0.255",
    "4111 1111-1111 1111 then 4111111111111112 and +49 (030) 123-4567. tel 030 123 4567",
    'é token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end',
    "9" * 40000 + " a@b.c" + "x" * 30000,
    "1 " * 20000,
    "",
    None,
    "a@b.c@d.e.f +1 +2 3 ((((5",
]


def test_base_spans_match_brute_force(spark, sf_tiny):
    texts = CASES + [r[0] for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").select("text").collect()]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "z@z.zz")]
    out = find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    for r in out:
        want = brute("z@z.zz" if r.doc_id is None else texts[r.doc_id])
        got = [s for s in r.spans.split(",") if s.split(":")[0] in PATTERNS]
        assert got == want, r.doc_id
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r.n_email == sum(s.startswith("email") for s in want)


def test_empty_table(spark):
    assert find_pii(spark.createDataFrame([], "doc_id long, text string, kind string")).collect() == []


def test_added_spans_follow_the_format_of_named_ones(spark):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'words token = "{key(i)}" words') for i in range(300)]
    rows += [(1000 + i, f'words = "{key(1000 + i)}" words') for i in range(8)]
    rows += [(2000 + i, f"words {'abcdefghij'[i % 10] * 12 + 'longplainword' * 2} words") for i in range(300)]
    out = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        at = text.find('"') + 1
        want = f"secret:{at}:{at + 40}" if i < 2000 else ""
        assert out[i].spans == want and out[i].n_spans == bool(want), i
