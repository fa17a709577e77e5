import random

from clonelake.operators.packed import DELIMITERS, explode_packed


def by_hand(field):
    """A plain scanner of one field."""
    if field is None:
        return []
    s = field.strip()
    if len(s) > 1 and s[0] + s[-1] in ("()", "[]", "{}"):
        s = s[1:-1]
    out, now, i, quoted = [], "", 0, False
    while i < len(s):
        c = s[i]
        if quoted:
            if c == '"' and s[i + 1 : i + 2] == '"':
                now += '"'
                i += 1
            elif c == '"':
                out.append(now)
                now, quoted = "", False
            else:
                now += c
        elif c == '"':
            out.append(now)
            now, quoted = "", True
        elif c in DELIMITERS or c.isspace():
            out.append(now)
            now = ""
        else:
            now += c
        i += 1
    return [x for x in [*out, now] if x]


CASES = [None, "", "  ", "A*01:02", 'A*01:02,"B*02 ""low""" ; ,C*1', "(A+B\tC)", '["A, B" C]', '"a""b"', '"(x)"', ",,;", 'A "B|C"；D、E，F', "A\nB", '"open, to the end', "A\xa0B", "\u3000A\u3000B\u2009", '""', "{A}"]


def test_fields(spark):
    df = spark.createDataFrame([(i, x, "clash", 0) for i, x in enumerate(CASES)], "id int, f string, val string, pos int")
    got = {}
    for r in explode_packed(df, "f", ["id"]).orderBy("id", "pos").collect():
        assert r.pos == len(got.setdefault(r.id, [])) + 1
        got[r.id].append(r.val)
    assert got == {i: v for i, x in enumerate(CASES) if (v := by_hand(x))}


def test_white_space_of_any_width(spark):
    wide = [chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]
    fields = [x for s in wide for x in (f"A*01:02{s}B*02:01", f"{s}[A{s}B；C]{s}", f'A{s}"x{s}y"{s}，B')]
    df = spark.createDataFrame(list(enumerate(fields)), "id int, f string")
    got = {}
    for r in explode_packed(df, "f", ["id"]).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.val)
    assert [got.get(i, []) for i in range(len(fields))] == [by_hand(x) for x in fields]


def test_random_fields(spark):
    rnd = random.Random(3)
    values = lambda: "".join(rnd.choice("AB*:") for _ in range(rnd.randint(1, 4)))
    fields = []
    for _ in range(300):
        parts = ['"' + (values() + rnd.choice([' ""x""', ", y", ""])) + '"' if rnd.random() < 0.3 else values() for _ in range(rnd.randint(0, 6))]
        text = "".join(p + rnd.choice([",", "; ", " | ", "\t", "，"]) for p in parts)
        fields.append(rnd.choice([text, "(" + text + ")"]))
    df = spark.createDataFrame(list(enumerate(fields)), "id int, f string")
    got = {}
    for r in explode_packed(df, "f", ["id"]).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.val)
    assert [got.get(i, []) for i in range(len(fields))] == [by_hand(x) for x in fields]


def test_long_and_empty(spark):
    df = spark.createDataFrame([(1, ",".join(["A*01:01"] * 30_000)), (2, '"x, y" ' * 5_000)], "id int, f string")
    assert {r["id"]: r["count"] for r in explode_packed(df, "f", ["id"]).groupBy("id").count().collect()} == {1: 30_000, 2: 5_000}
    assert explode_packed(df.limit(0), "f", ["id"]).count() == 0
