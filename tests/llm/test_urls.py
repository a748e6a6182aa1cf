from hypothesis import given
from hypothesis import strategies as st

from hetspark.llm import urls

SF = "/root/testdata/sf0.1"


def slow_rule(host, path):
    best = None
    for rule, verdict in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best or (None, None)


@given(st.lists(st.sampled_from(["www", "example", "com", "net", "m", "en", ""]), min_size=1, max_size=4), st.sampled_from(["", "/", "/en/", "/en", "/es/1", "/fr/", "x"]))
def test_longest_rule(labels, path):
    host = ".".join(labels)
    assert urls.Rules(urls.RULES).find(host, path) == slow_rule(host, path)


def test_parts():
    cases = {"HTTP://Www.Ex.COM:80/A?b#c": ("www.ex.com:80", "/A"), "http://É.com#x/y": ("É.com", ""), "no": ("", ""), None: ("", ""), "a://b://c/d": ("b:", "//c/d"), "://": ("", ""), "x://h?/p": ("h", ""), "\nx://h/\n": ("h", "/\n")}
    assert {u: urls.split_url(u) for u in cases} == cases


def test_every_gram_counts_once():
    parts = [("ab.c", "/x"), ("", ""), ("é", "/long/path")]
    owner, slot = urls.features(parts)
    want = [sum(max(0, len(b"^" + x.encode() + b"$") - n + 1) for x in p for n in urls.GRAMS) for p in parts]
    assert [int((owner == i).sum()) for i in range(3)] == want
    alone = [sorted(urls.features([p])[1].tolist()) for p in parts]
    assert [sorted(slot[owner == i].tolist()) for i in range(3)] == alone


def folds(table, n):
    """Urls that share a word of their hosts (of four letters or more) are in one fold."""
    import re

    fold, words = {}, [set(re.findall(r"[a-z]{4,}", urls.split_url(u)[0].rpartition(".")[0])) for u, _ in table]
    left = set(range(len(table)))
    sizes = [0] * n
    while left:
        group = {min(left)}
        while more := {i for i in left - group if any(words[i] & words[j] for j in group)}:
            group |= more
        left -= group
        k = sizes.index(min(sizes))
        sizes[k] += len(group)
        fold |= dict.fromkeys(group, k)
    return [fold[i] for i in range(len(table))], words


def test_held_out_words():
    """Right about urls none of whose host's words is in a url that the model has seen."""
    table = urls.labelled_urls()
    fold, words = folds(table, 8)
    right = 0
    for k in range(8):
        seen = {w for i, x in enumerate(words) if fold[i] != k for w in x}
        assert not any(words[i] & seen for i in range(len(table)) if fold[i] == k)
        model = urls.fit([x for x, f in zip(table, fold) if f != k])
        held = [x for x, f in zip(table, fold) if f == k]
        right += sum((s > 0) == bool(y) for (_, y), s in zip(held, model.scores([urls.split_url(u) for u, _ in held]), strict=True))
    assert right / len(table) > 0.9


def test_on_spark(spark):
    rows = [(1, "http://a.com/x"), (2, None), (3, "nothing"), (None, "http://www.example.com/en/1"), (5, "http://x.net/es/" + "y" * 100_000), (6, "http://m.example.com/en/2"), (6, "http://m.example.com/en/2"), (7, "http://casino-poker.org/bets"), (8, "http://a.com")]
    df = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id bigint, url string, host string, verdict string")
    out = urls.judge(df).collect()
    got = {r.page_id: (r.rule, r.verdict) for r in out}
    assert len(out) == len(rows)
    assert got == {1: ("com/", "allow"), 2: (None, got[2][1]), 3: (None, got[2][1]), None: ("www.example.com/en/", "allow"), 5: ("net/es/", "block"), 6: ("example.com/en/", "block"), 7: (None, "block"), 8: (None, "allow")}
    assert urls.judge(df.limit(0)).count() == 0


def plain_split(url):
    """Host and path as they are defined, character by character."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    host, path, inside = [], [], "host"
    for c in url[at + 3 :]:
        if c in "?#":
            break
        if c == "/" and inside == "host":
            inside = "path"
        if inside == "host":
            host.append(chr(ord(c) + 32) if "A" <= c <= "Z" else c)
        else:
            path.append(c)
    return "".join(host), "".join(path)


def test_stored_pages_against_a_plain_reading(spark):
    """Host, path, rule and the rules' verdicts of all stored pages; what no rule fits gets the model's own verdict."""
    from hetspark.llm.queries import op4_url_filter

    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in op4_url_filter(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    assert len(got) == len(pages)
    fitted = 0
    for p in pages:
        host, path = plain_split(p.url)
        fit = [(len(h) + len(start), h + start, kind) for kind, h, start in rules if (host == h or host.endswith("." + h)) and path.startswith(start)]
        r = got[p.page_id]
        assert (r.host, r.path) == (host, path) and r.verdict in ("allow", "block")
        if fit:
            fitted += 1
            assert (r.rule, r.verdict) == (max(fit)[1], max(fit)[2])
        else:
            assert r.rule is None
    assert fitted > 20
