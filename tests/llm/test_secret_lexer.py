"""The lexer on source and configuration syntax, on propagation, and on long texts."""

import time

import pytest

from clademill.llm import secrets as S

V = "hunter2Zq81LmPw"


def _found(text):
    return [text[s.start : s.end].strip() for s in S.lexed_spans(text)]


@pytest.mark.parametrize(
    "text",
    [f'X="{V}"; db_password = X; X="aaaaaaaa"', f'e="{V}"\nd=e\nc=d\nb=c\na=b\nsigning_key = a', f'signing_key = a\na=b\nb=c\nc=d\nd=e\ne="{V}"', f'private_key = """\n{V}\n"""', f'signing_key{" " * 50}={" " * 50}"{V}"',
     f'{"x" * 300}_password = "{V}"', f'{{"a": 1, "dbSecretKey": "{V}", "b": [1]}}', f"db:\n  auth_key: {V}\n  other: x", f"db:\n  private_key: |\n    {V}\n  other: x", f"export SIGNING_KEY={V}\ncurl", f"K={V}\nexport SIGNING_KEY=${{K}}",
     f'<conf signingKey="{V}" other="x"/>', f"<db><passphrase>{V}</passphrase></db>", f'<add key="ApiAuthKey" value="{V}" />', f'<string name="auth_key">{V}</string>', f'connect(host="x", auth_key="{V}")', f'auth_key: Optional[str] = "{V}"',
     f"run --auth-key {V} -v", f"run --auth-key={V} -v", f"AUTH_KEY=$(cat <<EOF\n{V}\nEOF\n)", f'setenv("AUTH_KEY", "{V}")', f':auth_key => "{V}"', f"cfg['db']['auth_key'] = '{V}'", f'# auth_key = "{V}"', f'os.system("tool auth_key={V} x")',
     f'p = "{V}"\nauth_key = prefix + p', f'if (auth_key := "{V}"): pass', f'self.auth_key = self.k\nself.k = "{V}"', f'auth_key = `{V}`', f'say("don\'t"); auth_key = b"{V}"'],
)
def test_one_literal_is_found(text):
    assert _found(text) == [V]


@pytest.mark.parametrize("text", [f'AUTH_KEY = "{V[:7]}" + "{V[7:]}";', f'auth_key = (\n  "{V[:7]}"\n  "{V[7:]}"\n)', f"auth_key = '{V[:7]}' \\\n    '{V[7:]}'"])
def test_joined_literals_are_one(text):
    assert _found(text) == [V[:7], V[7:]]


@pytest.mark.parametrize("text", [f'colour = "{V}"', 'password = "your-password"', 'password = os.getenv("DB_PASSWORD_NAME")', "The token: don't use it. Key: the answer; see 'notes'.", f'if auth_key == "{V}": x', f'auth_key = # none\nx = "{V}"', "auth_key = a\na = b\nb = a", "secret: ${SECRET}", "", "="])
def test_nothing_is_found(text):
    assert _found(text) == []


def test_the_last_binding_before_a_use_counts():
    other = "Tr0ub4dor93KxQz"
    text = f'x = "{V}"\nauth_key = x\nx = "{other}"\nsigning_key = x\n'
    assert _found(text) == [V, other] and _found(f'x = "{V}"\nx = "{other}"\nauth_key = x') == [other]


@pytest.mark.parametrize(
    "text",
    ['"\\"' * 300_000, "a=" * 500_000, "a:" * 500_000, "a = " + " " * 1_000_000 + "x", "<a " * 300_000, "'" * 1_000_000, '"""' * 333_333, '{"k":"v",' * 100_000, "x=<<E\n" * 150_000, "k: |\n  a\n" * 100_000, "x=(" * 300_000, "x='a" * 250_000,
     "x=`" * 300_000, "a: b c d " * 110_000, 'x="a"+' * 150_000, '<a name="token" ' + 'b="c" ' * 160_000 + ">", "x" * 1_000_000 + "=", 'password = "abcdefghijkl012345"\n' * 30_000, "\n".join(f"a{i}=a{i + 1}" for i in range(60_000))],
)
def test_a_megabyte_takes_seconds(text):
    began = time.process_time()
    S.scan(text)
    assert time.process_time() - began < 12


def test_a_long_chain_is_followed():
    chain = "\n".join(f"a{i}=a{i + 1}" for i in range(30_000))
    assert _found(f'{chain}\npassword=a0\na30000="{V}"') == [V]


def test_literals_inside_base_spans_are_not_repeated():
    text = f'token = "{V}"; X = "{V}"; auth_key = X'
    assert [(s.kind, text[s.start : s.end]) for s in S.scan(text)] == [("assign", f'token = "{V}'), ("literal", V)]
