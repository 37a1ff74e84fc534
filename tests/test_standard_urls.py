"""Published cases of URL parsing, and plain URLs that the pattern lets pass."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pressloom.functions import standard_urls as S

CASES = [
    ("http://example\t.\norg", "http://example.org/"), ("http://user:pass@foo:21/bar;par?b#c", "http://user:pass@foo:21/bar;par?b#c"), ("https:example.com/", "https://example.com/"), ("http://f:/c", "http://f/c"),
    ("http://f:0/c", "http://f:0/c"), ("http://f:00000000000080/c", "http://f/c"), ("http://f:b/c", None), ("http://f: /c", None), ("http://f:65536/c", None), ("http://f:fifty-two/c", None), ("  http://foo.com  ", "http://foo.com/"),
    ("http://example.com/././foo", "http://example.com/foo"), ("http://example.com/./.foo", "http://example.com/.foo"), ("http://example.com/foo/.", "http://example.com/foo/"), ("http://example.com/foo/./", "http://example.com/foo/"),
    ("http://example.com/foo/bar/..", "http://example.com/foo/"), ("http://example.com/foo/bar/../ton", "http://example.com/foo/ton"), ("http://example.com/foo/bar/../ton/../../a", "http://example.com/a"), ("http://example.com/foo/../../..", "http://example.com/"),
    ("http://example.com/foo/%2e", "http://example.com/foo/"), ("http://example.com/foo/%2e%2", "http://example.com/foo/%2e%2"), ("http://example.com/foo/%2e./%2e%2e/.%2e/%2e.bar", "http://example.com/%2e.bar"), ("http://example.com////../..", "http://example.com//"),
    ("http://example.com/foo%", "http://example.com/foo%"), ("http://example.com/foo%00%51", "http://example.com/foo%00%51"), ("http://example.com/foo\tbar", "http://example.com/foobar"), ("http://example.com\\\\foo\\\\bar", "http://example.com//foo//bar"),
    ("http://example.com/%7Ffp3%3Eju%3Dduvgw%3Dd", "http://example.com/%7Ffp3%3Eju%3Dduvgw%3Dd"), ("http://example.com/你好你好", "http://example.com/%E4%BD%A0%E5%A5%BD%E4%BD%A0%E5%A5%BD"), ("http://www.google.com/foo?bar=baz# »", "http://www.google.com/foo?bar=baz#%20%C2%BB"),
    ("http://user@/www.example.com", None), ("http:@/www.example.com", None), ("http://@/www.example.com", None), ("http://a:b@www.example.com", "http://a:b@www.example.com/"), ("http://:b@www.example.com", "http://:b@www.example.com/"), ("http://a:@www.example.com", "http://a@www.example.com/"), ("http://www.@pple.com", "http://www.@pple.com/"),
    ("http://ExAmPlE.CoM", "http://example.com/"), ("http://example example.com", None), ("http://Goo%20 goo%7C|.com", None), ("http://GOO \u3000goo.com", None), ("http://www.foo。bar.com", "http://www.foo.bar.com/"), 
    ("http://Ｇｏ.com", "http://go.com/"), ("http://你好你好", "http://xn--6qqa088eba/"), ("http://bücher.example/", "http://xn--bcher-kva.example/"), ("http://192.168.0.1", "http://192.168.0.1/"), ("http://0xc0.0250.01", "http://192.168.0.1/"), ("http://0x7f.1/", "http://127.0.0.1/"),
    ("http://192.168.0.257", None), ("http://192.168.0.1 hello", None), ("http://1.2.3.4.5/", None), ("http://256", "http://0.0.1.0/"), ("http://4294967295", "http://255.255.255.255/"), ("http://4294967296", None), ("http://0x", "http://0.0.0.0/"), ("http://1.2.08", None), ("http://foo.0x4", None), ("http://192.168.257.", "http://192.168.1.1/"),
    ("http://[1::2]:3:4", None), ("http://[::1]", "http://[::1]/"), ("http://[2001::1]", "http://[2001::1]/"), ("http://[1:0::]", "http://[1::]/"), ("http://[0:1:2:3:4:5:6:7:8]", None), ("http://[::127.0.0.1]", "http://[::7f00:1]/"), ("http://[0:0:0:0:0:0:13.1.68.3]", "http://[::d01:4403]/"), ("http://[1:0:0:2:0:0:0:3]", "http://[1:0:0:2::3]/"), ("http://[google.com]", None), ("http://[::1.2.3.4x]", None),
    ("https://x/?a='b\"c<d>", "https://x/?a=%27b%22c%3Cd%3E"), ("https://x/a b?c d#e f", "https://x/a%20b?c%20d#e%20f"), ("https://x/?", "https://x/?"), ("https://x:443/", "https://x/"), ("ftp://f:21/x", "ftp://f/x"), ("wss://h:8443", "wss://h:8443/"), ("mailto:a@b.no", None), ("//x/y", None), ("nothing", None), ("", None),
]


def test_published_cases():
    assert not [(u, S.standard(u), w) for u, w in CASES if S.standard(u) != w]


@pytest.mark.parametrize("seed", [1, 2])
def test_columns(spark, seed):
    rng = random.Random(seed)
    pieces = ["https://", "http://", "a.no", "www.b.com", ":8080", ":443", ":80", "/", "/x", "/.", "/..", "/%41", "?", "a=1", "&b=%20", "#", "é", " ", "A", "@", "//", "'"]
    urls = ["".join([rng.choice(pieces[:2]), rng.choice(pieces[2:4]), *rng.choices(pieces, k=rng.randint(0, 6))]) for _ in range(1500)] + [u for u, _ in CASES] + [None]
    got = [r.s for r in spark.createDataFrame(list(enumerate(urls)), "i int, u string").select("i", S.in_standard_form(F.col("u")).alias("s")).orderBy("i").collect()]
    assert got == [None if u is None else S.standard(u) for u in urls]
    plain = [u for u in urls if u and re.search(S.PLAIN, u)]
    assert len(plain) > 80 and all(S.standard(u) == u for u in plain)
    assert [S.standard(x) for x in got if x] == [x for x in got if x]
