import random

from inkwell.llm import secrets

random.seed(5)
BODY = ["".join(random.choices("ABCDEFghijkl0123456789+/", k=64)) for _ in range(12)] + ["Qx9+Zw=="]
HEAD, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


def redacted(text):
    return secrets.redact(text, [(a, b) for a, _, b, _ in secrets.find_spans(text)])


def test_no_key_material_is_left():
    key = "\n".join([HEAD, *BODY, END])
    for made in (key, key.replace("\n", "\r\n"), key.replace("\n", "\\n"), key.replace("\n", " "), key.replace("\n", '\\n" +\n  "'), key.replace(HEAD, HEAD + "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0011223344\n")):
        assert redacted(f"before {made} after") == "before [SECRET] after"
        cut = made[: made.index("-----END")].rstrip(' \r\n\\n"+')
        out = redacted(f"before {cut}\n\nplain words follow")
        assert out.startswith("before [SECRET]") and out.endswith("plain words follow") and not any(x in out for x in BODY)
        assert redacted(f"{cut}\n{made}") in ("[SECRET][SECRET]", "[SECRET]\n[SECRET]")
    assert redacted(f"the line {HEAD} opens a key") == "the line [SECRET] opens a key"


def test_ledgers_of_the_old_rule_are_scanned_again(spark, tmp_path):
    text = "\n".join([HEAD, *BODY, END])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    old = (*secrets.RULES[:-1], secrets.Rule("pem", 1, lambda t: [m.span() for m in secrets._PEM.finditer(t)], base=False))
    path = f"file://{tmp_path}/ledger"
    secrets.scan_versions(spark, docs.selectExpr("doc_id AS path", "text"), path, old).collect()
    assert [r.text for r in secrets.redacted(spark, docs, path).collect()] == ["[SECRET]"]


def test_many_headers_take_linear_time():
    secrets.find_spans((HEAD + "\n") * 20_000)
