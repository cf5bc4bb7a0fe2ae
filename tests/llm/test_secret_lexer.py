"""The lexer of the secret scan: syntax by syntax, planted secrets, a plain lexer, and work that stays linear."""

import random
import string
import time

import pytest

from tidelog.llm import secrets

SECRET = "Zx9!kdkJ3mm2pQ"


def found(text):
    return {text.encode()[s.start : s.end].decode() if text.isascii() else text[s.start : s.end] for s in secrets.scan(text.encode()) if s.kind == 3}


@pytest.mark.parametrize(
    "text",
    [
        f'password = "{SECRET}"', f"password: {SECRET}\n", f"password: |\n  {SECRET}\nother: 1", f'<add key="DB_PASSWORD" value="{SECRET}"/>',
        f"<password>{SECRET}</password>", f'define("DB_PASSWORD", "{SECRET}");', f'password = """{SECRET}"""', f'# password = "{SECRET}"',
        f'пароль_password = "{SECRET}"', f"os.environ['API_TOKEN'] = '{SECRET}'", f'password: str = "{SECRET}"', f'conn = "Server=a;Password={SECRET};Db=x"',
        f'{{"user": "bob", "password": "{SECRET}"}}', f'char password[] = "{SECRET}";', "A" * 5000 + f'_password = "{SECRET}"', f'K = "{SECRET}"\npassword = K\n',
        f"$db['password'] => '{SECRET}'", f'/* password = "{SECRET}" */ x', f'a = "{SECRET}"\nb = a\nc.password = b', f'password := `{SECRET}`',
    ],
)
def test_syntax(text):
    assert SECRET in found(text)


@pytest.mark.parametrize("text", ["password == other", "don't say password: it's 'fine' he said", 'x = 1 # K = "Zx9!kdkJ3mm2pQ"\npassword = K\n', "password != 'Zx9!kdkJ3mm2pQ'", "<password>", "password =", "(("])
def test_no_pair(text):
    assert not any(len(x) > 7 for x in found(text))


def test_parts_over_lines():
    assert found('password = ("Zx9!kd"\n   "kJ3mm2pQ")') == {"Zx9!kd", "kJ3mm2pQ"}
    assert found("password: |\n  Zx9!kdkJ3mm2pQ\n  second9Line\nother: 1") == {"Zx9!kdkJ3mm2pQ", "second9Line"}


@pytest.mark.parametrize(
    "text",
    [
        'password = "Zx9!kdkJ3mm2pQ"\n' + "password = password + password\n" * 10_000,
        'a0 = "Zx9!"\n' + "".join(f'a{i + 1} = a{i} + "x{i}"\n' for i in range(10_000)) + "password = a10000\n",
        *(x * 20_000 for x in ('"""', "'", '"', "(", "x=", "x:", "/*", "<a ", '("a", ', "# ", "<a x='1' ", "`")),
    ],
)
def test_linear(text):
    began = time.time()
    spans = secrets.scan(text.encode())
    assert time.time() - began < 8 and all(0 <= s.score <= 1 for s in spans)


def test_eighteen_doublings():
    spans = [s for s in secrets.scan(('password = "Zx9!kdkJ3mm2pQ"\n' + "password = password + password\n" * 18).encode()) if s.kind == 3]
    assert [(s.start, s.end, s.score) for s in spans] == [(12, 26, 1.0)]


def test_planted_secrets_are_found_and_clean_values_are_not():
    rng = random.Random(3)
    names = ["password", "db_passwd", "API_KEY", "client_secret", "authToken", "AWS_ACCESS_KEY", "private_key", "user.pwd", "SIGNING_KEY", "credential"]
    shapes = ['{n} = "{v}"', "{n}: '{v}'", '"{n}": "{v}",', "export {n}={v}", "<{n}>{v}</{n}>", 'set("{n}", "{v}")', '<property name="{n}" value="{v}"/>', "{n} := `{v}`", 'cfg["{n}"] = "{v}"', 'self.{n} = "{v}"  # note']
    plain = ["title", "colour", "width", "author", "path", "label"]
    words = ["river", "stone", "garden", "window", "letter", "summer"]
    hit = total = wrong = clean = 0
    for _ in range(600):
        value = "".join(rng.choices(string.ascii_letters + string.digits, k=rng.randint(12, 40)))
        text = "\n".join(["some prose here, and more: as it goes", rng.choice(shapes).format(n=rng.choice(names), v=value), rng.choice(shapes).format(n=rng.choice(plain), v=rng.choice(words)), "the end."])
        got = found(text)
        total, hit = total + 1, hit + (value in got)
        clean, wrong = clean + 1, wrong + bool(got - {value})
    assert hit / total >= 0.98 and wrong == 0


def test_plain_lines_equal_a_plain_lexer():
    """Lines of ``name = "literal"`` alone, read by splitting them."""
    rng = random.Random(8)
    for _ in range(200):
        lines, expected, at = [], set(), 0
        for _ in range(rng.randint(1, 12)):
            name = "".join(rng.choices("abkeyptwdsn_", k=rng.randint(1, 9))) + rng.choice(["", "_key", "_password", ".token"])
            value = "".join(rng.choices("abcXYZ019!% ", k=rng.randint(0, 24)))
            line = f'{name} = "{value}"'
            weight = secrets.name_score(name.encode())
            if value and weight and min(1.0, round(weight * secrets.literal_score(value.encode(), weight >= secrets.SENSITIVE), 4)) >= secrets.THRESHOLD:
                start = at + len(name) + 4
                expected.add((start, start + len(value)))
            lines.append(line)
            at += len(line) + 1
        assert {(s.start, s.end) for s in secrets.scan("\n".join(lines).encode()) if s.kind == 3} == expected
