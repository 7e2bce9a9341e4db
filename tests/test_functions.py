import hashlib
import hmac

from pyspark.sql import functions as F

from ledgerloom.functions import crypto, secrets, text
from ledgerloom.operators.integrity import python_payload


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column).collect()]


def test_paths(spark):
    good, bad = ["internal/auth/token.go", "main.go", "foo/../bar.go", "a/./b"], ["", "/etc/x", "../../etc", "../bar.go", "..", "a/../../b"]
    assert one(spark, text.valid_path("x"), *good, *bad) == [True] * 4 + [False] * 6
    assert one(spark, text.note_path("x"), "cmd/main.go", "index/sneaky.go", "../a") == [f"{text.STATE_DIR}/index/cmd/main.go.md", None, None]
    keys = one(spark, text.local_import_path("x", "example.com/m"), "src/lib/foo.ts", "src/lib/foo/index.ts", "src/pages/index.astro", "scripts/tool.mjs", "styles.css", "a/b.go", "c.go")
    assert keys == ["src/lib/foo", "src/lib/foo", "src/pages", "scripts/tool", None, "example.com/m/a", "example.com/m"]


def test_scalars(spark):
    assert [tuple(r) if r else None for r in one(spark, text.diff_stat("x"), "+5 -2", "+0 -0", "3 4", "", "+5", "binary")] == [(5, 2), (0, 0), (3, 4), None, None, None]
    assert one(spark, text.commitish("x"), "", "abcdef1", "a" * 64, "-s", "HEAD", "abc", "z" * 40) == [True, True, True, False, False, False, False]
    assert one(spark, text.like_escape("x"), "100%", "foo_bar", "a\\b") == ["100\\%", "foo\\_bar", "a\\\\b"]
    assert one(spark, text.md_escape("x"), "<a&b> *[x](y)* \\_`") == ["&lt;a&amp;b&gt; \\*\\[x\\]\\(y\\)\\* \\\\\\_\\`"]
    assert one(spark, text.short_hash("x"), "0123456789", "", None) == ["01234567", "uncommitted", "uncommitted"]
    assert one(spark, text.parse_timestamp("x"), "12", "1970-01-02", "1970-01-01T00:01:00", "1970-01-01T01:00:00+01:00", "2026-06", "x") == [12, 86400, 60, 0, None, None]
    assert one(spark, text.encode_counts(text.decode_counts("x")), "go:5,typescript:2", "") == ["go:5,typescript:2", ""]
    assert one(spark, text.truncate_bytes("x", 4), "añoñ", "abc", "日本") == ["año", "abc", "日"]
    link = text.note_link(F.lit("index/pkg/lib"), F.lit("cmd/main.go"), F.col("x"))
    assert one(spark, link, "cmd/main.go") == ["[cmd/main.go](../../cmd/main.go.md)"]
    assert one(spark, text.note_link(F.lit("."), F.lit("b"), F.col("x")), "d/b (1)[2].go") == ["[b](index/d/b%20%281%29%5B2%5D.go.md)"]


def test_hmac_and_payload(spark):
    row = {"prev_hmac": "p", "file_path": 'a"b\\c', "branch": "m", "source": "agent", "summary": "<x>& \x1b\n", "reason": None, "diff_stat": "+1 -2", "diff_hash": "", "agent_id": "ü", "recorded_at": 7}
    df = spark.createDataFrame([tuple(row.values())], "prev_hmac string, file_path string, branch string, source string, summary string, reason string, diff_stat string, diff_hash string, agent_id string, recorded_at long")
    got = df.select(crypto.signed_payload().alias("p"), crypto.hmac_sha256(crypto.signed_payload(), b"k" * 80).alias("h")).first()
    assert got["p"] == python_payload(row) and "\\u003cx\\u003e\\u0026\\u2028\\u001b\\n" in got["p"]
    assert got["h"] == hmac.new(b"k" * 80, got["p"].encode(), hashlib.sha256).hexdigest()
    assert crypto.derive_key(b"s", "a") != crypto.derive_key(b"s", "b") and len(crypto.derive_key(b"s", "")) == 32


def test_secrets(spark):
    aws, token = "AK" + "IA" + "A" * 16, "gh" + "p_" + "a" * 36
    jwt = "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "."
    key = "-----BEGIN RSA " + "PRIVATE KEY-----"
    hits = one(spark, secrets.first_secret(F.col("x")), aws, token, key, jwt, "clean", "eyJshort.eyJshort.nopair")
    assert [bool(h) for h in hits] == [True] * 4 + [False] * 2
    diff = f"diff --git a/.env b/.env\n--- a/.env\n+++ b/.env\n@@ -1 +1 @@\n-A=1\n+A=2\ndiff --git a/m.go b/m.go\n--- a/m.go\n+++ b/m.go\n@@ -1 +1 @@\n+x := 1\n+k := {aws}"
    want = diff.replace("-A=1", secrets.REDACTED).replace("+A=2", secrets.REDACTED).replace(f"+k := {aws}", secrets.REDACTED)
    assert one(spark, secrets.scrub_diff(F.col("x")), diff, "+plain") == [want, "+plain"]
    assert one(spark, secrets.is_secret_file(F.col("x")), "a/b.pem", "x/id_rsa.pub", "my_secret.txt", "main.go") == [True, True, True, False]
    long = one(spark, secrets.sanitise_summary(F.col("x")), "word " * 100, "a\nb", "use `x`", "ok  then", "abc")
    assert len(long[0].encode()) <= 240 and long[1:] == [None, None, "ok then", None]


def test_times_in_any_zone(spark):
    from ledgerloom.functions import text

    rows = spark.createDataFrame([("1970-01-02",), ("1970-01-02T00:00:01",), ("1970-01-02T00:00:01Z",), ("1970-01-02T09:00:01+09:00",), ("86400",), ("soon",)], "t string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = rows.select(text.parse_timestamp("t").alias("s")).select("s", text.format_time("s").alias("f")).collect()
            assert [r["s"] for r in got] == [86400, 86401, 86401, 86401, 86400, None], zone
            assert [r["f"] for r in got[:2]] == ["1970-01-02T00:00:00Z", "1970-01-02T00:00:01Z"] and got[5]["f"] is None
            big = spark.createDataFrame([(0,), (-1,), (4102444800,)], "s long").select(text.format_time("s").alias("f"))
            assert [r["f"] for r in big.collect()] == ["unknown", "1969-12-31T23:59:59Z", "2100-01-01T00:00:00Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
