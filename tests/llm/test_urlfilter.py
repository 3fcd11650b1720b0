import random
import re

from riskgrid.llm import urlfilter as U


def regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + "(?s:.*)", i + 2
            continue
        out += {"*": "[^/]*", "?": "(?s:.)"}.get(glob[i], re.escape(glob[i]))
        i += 1
    return re.compile(out)


def test_automaton_equals_regular_expressions():
    rng = random.Random(3)
    globs = list(U.BLOCK_GLOBS) + ["", "*", "**", "?", "a*b**c?", "*a", "a*", "***/x", "é?**"] + [
        "".join(rng.choice(["a", "b", "/", "*", "**", "?", "é"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = ["", "/", "a", "a\nb"] + ["".join(rng.choice("ab/é.\U0001f600") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += ["ads.x/y", "x.ads.com/a", "h/login", "h/login/z", "h/a.pdf", "m.h/a", "x" * 5000 + "/a.zip"]
    hit = U.matches(U.compile_globs(globs), texts)
    for g, glob in enumerate(globs):
        r = regex(glob)
        assert [bool(r.fullmatch(t)) for t in texts] == hit[:, g].tolist(), glob


def test_contract_rows(spark):
    urls = {1: None, 2: "no scheme example.org/es/", 3: "HTTP://Example.ORG/es/1?x#y", 4: "http://a.example.org/en/12", 5: "http://org",
            6: "http://x.org/", 7: "http://xorg/", 8: "http://com/fr/", 9: "http://a.com/de/x", 10: "http://a.com/x.org/de",
            11: "http://a://b.org/", 12: "http://m.site.net/a", 13: "://org/x", 14: "http://ÀB.org/\n/x?y", 15: "", 16: "http://org?q/"}
    rows = spark.createDataFrame([(k, v, "h", "z") for k, v in urls.items()] + [(None, "http://x.org/a", None, None)],
                                 "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(rows).collect()}
    assert got[1] == got[2] == got[15] == ("", "", None, "allow")
    assert got[3] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[4] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[5] == ("org", "", None, "allow") and got[16] == ("org", "", None, "allow")
    assert got[6] == ("x.org", "/", "org/", "allow") and got[7] == ("xorg", "/", None, "allow")
    assert got[8] == ("com", "/fr/", "com/fr/", "allow") and got[9] == ("a.com", "/de/x", "com/de/", "block")
    assert got[10] == ("a.com", "/x.org/de", None, "allow")
    assert got[11] == ("a:", "//b.org/", None, "allow")
    assert got[12] == ("m.site.net", "/a", None, "block")
    assert got[13] == ("org", "/x", "org/", "allow") and got[14] == ("Àb.org", "/\n/x", "org/", "allow")
    assert got[None] == ("x.org", "/a", "org/", "allow")
    assert U.judge(rows.limit(0)).count() == 0
