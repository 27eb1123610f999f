import re

from quire.llm import surrogates

KEY = "test key"
SCHEMA = "doc_id long, text string, surrogate string"


def run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    return {r["doc_id"]: r for r in surrogates.report(df.select("doc_id", "text"), KEY, **kw).collect()}


def test_kinds_and_formats(spark):
    texts = [
        "write to Ann.Lee42@mail.example.com or ANN.LEE42@MAIL.EXAMPLE.COM now",
        "call +1 (017) 555-7713, pay 4845 1681-4407 3295 or 4845168144073295",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" at 97.51.17.173',
        "Mr. John Smith met Mrs Smith and Frau Weber; г-н ignored, Г-жа Иванова came",
        "ssn 123-45-6789 and DE44 5001 0517 5407 3249 31",
        "Licensed under CC BY-NC 4.0. version 3.14, 2024-01-02 and v1.2.3.4.5",
        "",
        None,
    ]
    got = run(spark, texts)
    t = {i: r["text"] for i, r in got.items()}
    mails = re.findall(r"\S+@\S+", t[0])
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower() and mails[1].isupper() and mails[0].lower().endswith(".com") and mails[0].lower() != "ann.lee42@mail.example.com"
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}, pay 4\d{3} \d{4}-\d{4} \d{4} or 4\d{15}", t[1]) and "555-7713" not in t[1]
    a, b = re.search(r"pay ([\d -]+) or (\d+)", t[1]).groups()
    assert re.sub(r"\D", "", a) == b != "4845168144073295"
    assert re.fullmatch(r'token = "[0-9a-f]{40}" at (\d{1,3}\.){3}\d{1,3}', t[2]) and "97.51.17.173" not in t[2]
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) and Frau (\w+); г-н ignored, Г-жа (\w+) came", t[3])
    assert m and m[2] == m[3] and m[1].endswith("n") and not {m[1], m[2]} & {"John", "Smith"} and len({m[1], m[2], m[4]}) == 3 and re.fullmatch("[А-Я][а-я]+", m[5])
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4} and DE\d{2} \d{4} \d{4} \d{4} \d{4} \d{2}", t[4])
    assert t[5] == texts[5] and t[6] == "" and t[7] is None
    assert [got[i]["n_entities"] for i in range(8)] == [2, 3, 2, 5, 2, 0, 0, 0]


def test_same_everywhere_and_distinct(spark):
    texts = [f"ip 10.0.{i // 250}.{i % 250 + 1} mail u{i}@x.example.org" for i in range(600)] * 2
    got = run(spark, texts)
    assert all(got[i]["text"] == got[i + 600]["text"] for i in range(600))
    assert len({got[i]["text"].split()[1] for i in range(600)}) == 600 and len({got[i]["text"].split()[3] for i in range(600)}) == 600
    other = {r["doc_id"]: r["text"] for r in surrogates.report(spark.createDataFrame([(0, texts[0])], "doc_id long, text string"), "other key").collect()}
    assert other[0] != got[0]["text"]


def test_collisions_are_drawn_again(spark):
    # two-letter addresses: so few that draws collide
    mails = [f"{a}{b}@q.example.com" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    from pyspark.sql import functions as F

    known = spark.createDataFrame([("secret", f"{i:02d}") for i in range(60)], "kind string, norm string")
    odd = {r["norm"]: r["s"] for r in surrogates.exceptions(known.cache(), KEY, most_rounds=400).collect()}
    first = {r["norm"]: r["s"] for r in known.select("norm", surrogates.draw(F.col("kind"), F.col("norm"), KEY, F.lit(0)).alias("s")).collect()}
    final = {n: odd.get(n, s) for n, s in first.items()}
    assert odd and len(set(final.values())) == 60 and not set(final.values()) & set(first)
    got = run(spark, [f"to {m}" for m in mails])
    assert len({r["text"] for r in got.values()}) == len(mails)


def test_other_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a@b.example.com", "own")], SCHEMA)
    row = surrogates.replace(df, KEY).first()
    assert row["surrogate"]["n_entities"] == 1 and row["doc_id"] == 1
    assert surrogates.replace(df.limit(0), KEY).count() == 0


def luhn(number):
    d = [int(c) for c in reversed(number)]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_names_corefer(spark):
    """A name is replaced wherever it stands in its document, with or without a title, also by its initial."""
    texts = [
        "Mr. John Smith came. Smith left; John Smith again. Dr. Smith, J. Smith and SMITH. Smithson and smith stay.",
        "Prof Jean-Luc O'Brien met Frau Weber. O'Brien's friend Jean-Luc, Weber too",
        "Mr John Paul von Braun. John, Paul, Braun",
        "no title: John Smith",
        "Mrs Anna McDonald saw Mr McDonald. McDonald!",
    ]
    got = {i: r["text"] for i, r in run(spark, texts).items()}
    m = re.fullmatch(r"Mr\. (\w+) (\w+) came\. (\w+) left; (\w+) (\w+) again\. Dr\. (\w+), (\w)\. (\w+) and (\w+)\. Smithson and smith stay\.", got[0])
    assert m, got[0]
    given, last = m[1], m[2]
    assert [m[i] for i in (3, 5, 6, 8)] == [last] * 4 and m[4] == given and m[7] == given[0] and m[9] == last.upper() and given != "John" and last != "Smith"
    for name in ("Jean", "Luc", "Brien", "Weber", "Paul", "Braun", "Anna", "McDonald"):
        assert not any(name in t for t in got.values()), (name, got)
    m = re.fullmatch(r"Prof (\w+-\w+) (\w'\w+) met Frau (\w+)\. (\w'\w+)'s friend (\w+-\w+), (\w+) too", got[1])
    assert m and m[2] == m[4] and m[1] == m[5] and m[3] == m[6], got[1]
    assert re.fullmatch(r"Mr (\w+) (\w+) von (\w+)\. \1, \2, \3", got[2]), got[2]
    assert got[3] == texts[3]
    assert re.fullmatch(r"Mrs (\w+na) (\w+) saw Mr \2\. \2!", got[4]), got[4]
    assert re.search(r"Mr\. (\w+)", run(spark, ["Mr. Jack Smith"])[0]["text"])[1][0] == given[0]


def test_surrogates_are_of_their_kind(spark):
    import ipaddress
    import random

    rng = random.Random(3)

    def card(prefix, n):
        body = prefix + "".join(rng.choice("0123456789") for _ in range(n - len(prefix) - 1))
        return next(body + c for c in "0123456789" if luhn(body + c))

    cards = [card("4", 16) for _ in range(20)] + [card("37", 15) for _ in range(20)]
    bodies = ["".join(rng.choice("0123456789") for _ in range(18)) for _ in range(20)]
    ibans = [next(f"DE{k:02d}{b}" for k in range(2, 99) if mod97(f"DE{k:02d}{b}")) for b in bodies]
    ssns = [f"{rng.randrange(1, 665):03d}-{rng.randrange(1, 99):02d}-{rng.randrange(1, 9999):04d}" for _ in range(60)]
    ips = [f"10.{rng.randrange(256)}.{rng.randrange(256)}.7" for _ in range(20)] + [f"192.168.{rng.randrange(256)}.9" for _ in range(20)] + [f"172.20.{rng.randrange(256)}.9" for _ in range(20)] + [f"93.{rng.randrange(256)}.1.{rng.randrange(256)}" for _ in range(20)]
    v6 = ["2001:db8:0:1:2:3:4:5", "fe80::1ff:fe23:4567:890a"]
    secrets = ["password: hunter22x", "api_key=Ab12Cd34Ef56", 'secret = "QWERTYuiop12"']
    values = cards + ibans + ssns + ips + v6 + secrets
    got = {i: r for i, r in run(spark, [f"so {v} then" for v in values]).items()}
    new = [re.fullmatch(r"so (.*) then", got[i]["text"])[1] for i in range(len(values))]
    assert all(a != b for a, b in zip(values, new)) and len(set(new)) == len(set(values)) and all(r["n_entities"] == 1 for r in got.values())
    assert not set(new) & set(values)
    at = iter(new)
    for old in cards:
        x = next(at)
        assert luhn(x) and len(x) == len(old) and x[0] == old[0]
    for _ in ibans:
        x = next(at)
        assert x.startswith("DE") and mod97(x)
    for _ in ssns:
        a, b, c = next(at).split("-")
        assert a not in ("000", "666") and a < "900" and b != "00" and c != "0000"
    for old in ips:
        a, b = ipaddress.ip_address(old), ipaddress.ip_address(next(at))
        assert a.is_private == b.is_private and (not a.is_private or str(b).split(".")[0] == old.split(".")[0])
    for old in v6:
        x = next(at)
        assert ipaddress.ip_address(x) and x.split(":")[0] == old.split(":")[0]
    assert re.fullmatch(r"password: [a-z]{6}\d\d[a-z]", next(at)) and next(at).startswith("api_key=") and re.fullmatch(r'secret = "[A-Z]{6}[a-z]{4}\d\d"', next(at))


def test_against_texts_of_known_parts(spark):
    """Texts put together from entities and other words: what is between stays, each entity always gets the same, no two the same."""
    import random

    rng = random.Random(8)
    mails = [f"u{i}.x@h{i % 7}.example.org" for i in range(40)]
    phones = [f"+1 (9{i:02d}) 555-{i * 37:04d}" for i in range(40)]
    tokens = [f"{rng.getrandbits(160):040x}" for _ in range(40)]
    fill = "the of 3.14 v2 2024-01-02 (see) a+b x=1 12:30:45 and, so. ¿qué? 北京 std::vector a::b\n\t".split(" ")
    rows = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 30)):
            parts.append((" ".join(rng.choice(fill) for _ in range(rng.randrange(1, 6))), None))
            kind = rng.randrange(4)
            if kind < 3:
                parts.append((rng.choice((mails, phones, tokens)[kind]), kind))
        rows.append(parts)
    write = lambda x, k: f'token = "{x}"' if k == 2 else x
    texts = [" ".join(write(x, k) for x, k in r) for r in rows]
    got = run(spark, texts)
    to = {}
    for i, r in enumerate(rows):
        pattern = " ".join(re.escape(x) if k is None else (r"(\S+@\S+)", r"(\+1 \(\d{3}\) 555-\d{4}|\+1 \(\d{3}\) \d{3}-\d{4})", r'token = "([0-9a-f]{40})"')[k] for x, k in r)
        m = re.fullmatch(pattern, got[i]["text"])
        assert m, (texts[i], got[i]["text"])
        for x, y in zip([x for x, k in r if k is not None], m.groups()):
            assert to.setdefault(x, y) == y and y != x
        assert got[i]["n_entities"] == sum(k is not None for _, k in r)
    assert len(set(to.values())) == len(to) and not set(to.values()) & set(to)


def test_long_and_repeated_texts(spark):
    texts = ["x@" + "a." * 20_000 + "com", "x@" + "ab." * 3 + "com " + "word " * 200_000 + "Mr Smith " + "Smith " * 2000, "1" * 300_000, "(1" * 100_000, "A1" * 100_000, "a:" * 100_000, "Mr " * 50_000, "+1 " * 50_000, "token=" * 50_000, "same c@d.example.com", "same c@d.example.com"]
    got = run(spark, texts)
    assert got[9]["text"] == got[10]["text"] != texts[9] and got[1]["text"].count("Smith") == 0 and got[1]["n_entities"] == 2002
    assert got[2]["text"] == texts[2] and got[6]["text"] == texts[6]


def test_used_up_formats_get_placeholders(spark):
    known = spark.createDataFrame([("secret", c) for c in "0123456789abcdef"], "kind string, norm string")
    odd = [r["s"] for r in surrogates.exceptions(known, KEY).collect()]
    assert len(set(odd)) == 16 and all(re.fullmatch(r"\[secret-[0-9a-f]{20}\]", s) for s in odd)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a@b.example.com", 2, 3, 4, "x"), (2, None, 2, 3, 4, "y")], "doc_id long, text string, r int, f int, h int, o string")
    got = sorted(map(tuple, surrogates.replace(df, KEY, out="s").drop("s").collect()))
    assert [(x[0], *x[2:]) for x in got] == [(1, 2, 3, 4, "x"), (2, 2, 3, 4, "y")] and got[1][1] is None and got[0][1] != "a@b.example.com"
