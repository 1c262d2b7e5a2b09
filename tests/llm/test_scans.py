import hashlib
import random
import re

import pytest
from conftest_llm import prose, table, words

from sensorweave.llm import licenses, secrets

ASSIGN = re.compile("(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return [(a, b, k) for a, _, b, k in sorted(found)]


def check(rows, docs):
    want = {}
    for i, t in docs:
        spans = base(t or "")
        counts = [sum(k == kind for _, _, k in spans) for kind in ("assign", "access", "hex")]
        want.setdefault(i, []).append((*counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_assign, r.n_access, r.n_hex, r.base_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_documents(documents, texts):
    check(secrets.secret_report(documents).collect(), texts.items())


def test_odd_rows(odd, none, odd_rows):
    check(secrets.secret_report(odd).collect(), odd_rows)
    assert secrets.secret_report(none).count() == secrets.redact_documents(none).count() == 0
    rows = {r.doc_id: r for r in secrets.redact_documents(odd).collect()}
    assert rows[2**62].text == "[secret]\"\nAll rights reserved." and rows[2**62].n_chars == len(rows[2**62].text)
    assert rows[1].text is None and rows[9].text == dict(odd_rows)[9]


@pytest.mark.parametrize(
    "text",
    ["token=secret=abcdefgh", "password: password: hunter22", "password=token:abcdefgh", "API_KEY = 'abc-123_x'", "ſecret=abcdefg toKen:abcdefg", "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "x" + "0a" * 12, "f" * 23, "é token = \"" + "0f" * 20 + "\""],
)
def test_base_patterns(text):
    assert secrets.base_spans(text) == base(text)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('db_pwd: zaq12wsxCDE3', ["zaq12wsxCDE3"]),
        ('k = "a1b2c3d4e5f6G7"\nconst clientSecretKey = k', ["a1b2c3d4e5f6G7"]),
        ('a = "Zx9Q"\nb = a\nauth_token_value = b + "yT77qqw1"', ["Zx9Q", "yT77qqw1"]),
        ('"private-key" => \'MIIEvQ0982hT\'', ["MIIEvQ0982hT"]),
        ("PWD=changeme", []),
        ("db_pwd=${DB_PWD}", []),
        ("colour = \"a1b2c3d4e5f6G7\"", []),
        ("note: the pwd is written on the wall", []),
        ("pwd == x1y2z3w4Q", []),
    ],
)
def test_assigned_names(text, found):
    assert [text[a:b] for a, b, k in secrets.assigned_spans(text)] == found


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('{"user": "x", "pwd": "zaq12wsxCDE3"}', ["zaq12wsxCDE3"]),
        ('connect("db", db_pwd="zaq12wsxCDE3", port=5432)', ["zaq12wsxCDE3"]),
        ("A=1; DB_PWD=zaq12wsxCDE3", ["zaq12wsxCDE3"]),
        ("docker run -e DB_PWD=zaq12wsxCDE3 --db-pwd=qwe45rtyDFG6 image", ["zaq12wsxCDE3", "qwe45rtyDFG6"]),
        ('if on: k = "a1b2c3d4e5f6G7"\nand then clientSecretKey = k', ["a1b2c3d4e5f6G7"]),
        ("url = 'Server=a;Pwd=zaq12wsxCDE3;Port=1'", ["zaq12wsxCDE3"]),
        ('$a = "Zx9Q";\n$db_pwd = $a . "yT77qqw1";', ["Zx9Q", "yT77qqw1"]),
        ('a = "Zx9Q"\nauth_token_value = a."yT77qqw1"', ["Zx9Q", "yT77qqw1"]),
        ('f(auth_token_value="Zx9Q" "yT77qqw1")', ["Zx9Q", "yT77qqw1"]),
        ("<db><dbPwd> zaq12wsxCDE3 </dbPwd><note>a1b2c3d4e5f6G7</note></db>", ["zaq12wsxCDE3"]),
        ('<add key="DbPwd" value="zaq12wsxCDE3"/><add key="Colour" value="a1b2c3d4e5f6G7"/>', ["zaq12wsxCDE3"]),
        ("<property name='db.pwd' type='x' value='zaq12wsxCDE3'/>", ["zaq12wsxCDE3"]),
        ('db_pwd = """zaq12wsxCDE3"""\nx = 1', ["zaq12wsxCDE3"]),
        ("k = \'\'\'\nMIIEvQ0982hT\'\'\'\nx = 1", []),
        ('db_pwd = ("Zx9Q"\n          "yT77qqw1")\ncolour = "a1b2c3d4e5f6G7"', ["Zx9Q", "yT77qqw1"]),
        ('db_pwd = "Zx9Q" + \\\n    "yT77qqw1"', ["Zx9Q", "yT77qqw1"]),
        ('db_pwd = "Zx9Q" \\\n    "yT77qqw1"\nz = 1', ["Zx9Q", "yT77qqw1"]),
        ('const dbPwd = "Zx9Q" +\n    "yT77qqw1";\nlet a = "a1b2c3d4e5f6G7"', ["Zx9Q", "yT77qqw1"]),
        ("db:\n  pwd: |\n    zaq12wsxCDE3\n  port: 1", ["zaq12wsxCDE3"]),
        ("db_pwd = `zaq12wsxCDE3`", ["zaq12wsxCDE3"]),
        ("we said the pwd: see the wall. Then pwd != x1y2z3w4Q and Pwd::x1y2z3w4Q", []),
    ],
)
def test_assignments_inside_lines(text, found):
    assert [text[a:b] for a, b, k in secrets.assigned_spans(text)] == found


def test_constants_of_many_literals_are_whole():
    parts = [f"aB{i}x" for i in range(100)]
    grown = 'k = "old"\nk = "start1"\n' + "".join(f'k = k + "{x}"\n' for x in parts) + "db_pwd = k"
    assert [grown[a:b] for a, b, _ in secrets.assigned_spans(grown)] == ["start1", *parts]
    line = 'k = "old"\nk = ' + " + ".join(f'"{x}"' for x in parts) + "\ndb_pwd = k"
    assert [line[a:b] for a, b, _ in secrets.assigned_spans(line)] == parts
    doubled = 'a = "zaq12wsxCDE3"\n' + "a = a + a\n" * 200 + "db_pwd = a"
    assert [doubled[a:b] for a, b, _ in secrets.assigned_spans(doubled)] == ["zaq12wsxCDE3"]


def test_prose_has_no_assigned_secrets(texts):
    assert all(k != "name" for t in texts.values() for _, _, k in secrets.all_spans(t)[1])


def test_licenses(spark, odd, none):
    body = prose(300, 1)
    mit = licenses.TEMPLATES["MIT"]
    changed = re.sub(r"\bSoftware\b", "Program", mit, count=2)
    rows = [(1, body + "\n" + licenses.TEMPLATES["MIT-notice"]), (2, body[:500] + "\n" + mit.upper() + "\n" + body), (3, changed), (4, body), (5, "the rights were reserved"), (6, None), (7, "")]
    found = licenses.license_matches(table(spark, rows)).collect()
    got = {(r.doc_id, r.template) for r in found}
    assert got == {(1, "MIT-notice"), (2, "MIT"), (3, "MIT")}
    for r in found:
        if r.template == "MIT-notice":
            assert body not in dict(rows)[1][r.start_char : r.end_char] and dict(rows)[1][r.start_char : r.end_char].startswith("Released under")
        assert r.containment >= 0.8
    assert {(r.doc_id, r.template) for r in licenses.license_matches(odd).collect()} == {(2**62, "rights-reserved")}
    assert licenses.license_matches(none).count() == 0


def test_licenses_against_brute_force(documents, texts):
    def held(t, n):
        g = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
        return g

    want = set()
    for name, template in licenses.TEMPLATES.items():
        w = licenses.plain_words(template.encode())
        k = min(5, len(w))
        for i, t in texts.items():
            if held(w, k) <= held(licenses.plain_words(t.encode()), k):
                want.add((i, name))
    got = {(r.doc_id, r.template) for r in licenses.license_matches(documents).collect() if r.containment == 1.0}
    assert got == want and want


def test_marks_of_unicode_part_words(spark):
    rows = [
        (1, "under the \u201cApache License, Version\u00a02.0\u201d"),
        (2, "\u00a92024 X \u2014\u201cAll rights reserved\u201d\u2026 fin"),
        (3, "Licensed under the\u2003Apache License,\u00a0Version 2.0\u3002"),
        (4, "\uff08Released under the MIT License\uff09 tr\u00e8s \u00e9t\u00e9"),
        (5, "\u00e9All rights reserved"),
    ]
    found = licenses.license_matches(table(spark, rows)).collect()
    text = dict(rows)
    assert {(r.doc_id, r.template, text[r.doc_id][r.start_char : r.end_char]) for r in found} == {
        (2, "rights-reserved", "All rights reserved"),
        (3, "Apache-2.0-notice", "Licensed under the\u2003Apache License,\u00a0Version 2.0"),
        (4, "MIT-notice", "Released under the MIT License"),
    }
    for c in map(chr, range(128, 0x10000)):
        if not 0xD800 <= ord(c) < 0xE000 and c.isalpha() and not 0x2000 <= ord(c) < 0x2C00:
            assert licenses.plain(c.encode()).strip()


def contained(template, text):
    w = licenses.plain_words(template.encode())
    k = min(5, len(w))
    t = licenses.plain_words(text.encode())
    want = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return len(want & {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}) / len(want)


def test_changed_templates_against_brute_force(spark):
    """Edited copies alone in their text: containment over the text is that of the copy."""
    rng = random.Random(2)
    rows, at = [], 0
    for name, template in licenses.TEMPLATES.items():
        for edits in range(0, 12):
            w = template.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(["", "word other", "Program"])
            rows.append((at, prose(20, at) + "\n" + " ".join(w) + "\n" + prose(20, 1000 + at)))
            at += 1
    got = {(r.doc_id, r.template): r.containment for r in licenses.license_matches(table(spark, rows)).collect()}
    want = {(i, name): share for i, t in rows for name, template in licenses.TEMPLATES.items() if (share := contained(template, t)) >= 0.8}
    assert got.keys() <= want.keys() and len(got) >= 0.99 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_whole_license_texts(spark, tmp_path):
    body = words(3000, 1)
    (tmp_path / "Long-1.0.txt").write_text(" ".join(body))
    rows = [(1, prose(50, 2) + " " + " ".join(w for i, w in enumerate(body) if i % 40) + " " + prose(50, 3)), (2, " ".join(body[:2000]))]
    found = licenses.license_matches(table(spark, rows), licenses.read_templates(str(tmp_path))).collect()
    assert [(r.doc_id, r.template) for r in found] == [(1, "Long-1.0")]


def test_bands_guarantee():
    assert licenses.collision_probability(1.0) == 1.0
    assert licenses.collision_probability(2 / 3) > 0.99
