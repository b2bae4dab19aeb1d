import re

from factloom.llm import secrets
from factloom.llm.secrets import candidates, known_findings, redacted, secret_findings
from tests.llm.common import MEDIUM, documents, plain, table

PATTERN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
TOKEN = re.compile(r'token = "([0-9a-f]{40})"')


def test_candidates_and_positions(spark):
    texts = ["x" * 16 + " é " + "y" * 20, "none", None, "", "a" * 40_000 + ".\n" + "ab12" * 5, "=" * 16]
    docs = table(spark, [*texts, texts[0]], [0, 1, 2, 3, 4, None, 0], value="v", nth="n")
    want = sorted(
        ((i, n, m.start(), m.group()) for i, t in zip([0, 1, 2, 3, 4, None, 0], [*texts, texts[0]])
         for n, m in enumerate(PATTERN.finditer(t or ""))), key=str)
    assert sorted(plain(candidates(docs), "doc_id", "nth", "start", "value"), key=str) == want


def test_real_secrets_stay_and_false_positives_go(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    found = secret_findings(docs).collect()
    texts = dict(documents(MEDIUM))
    assert len(found) == sum(len(PATTERN.findall(t)) for t in texts.values())
    for r in found:
        before = texts[r["doc_id"]][: r["start"]]
        real = bool(TOKEN.search(texts[r["doc_id"]], max(0, r["start"] - 9), r["end"] + 1)) and before.endswith('"')
        assert r["is_secret"] == real and texts[r["doc_id"]][r["start"] : r["end"]] == r["value"]
    clean = redacted(docs, secret_findings(docs))
    assert clean.columns == docs.columns and clean.count() == docs.count()
    for i, text in plain(clean, "doc_id", "text"):
        assert text == TOKEN.sub('token = "[secret]"', texts[i])


def test_reviewed_labels_train(spark):
    real = [f'password: "{i:04d}aB9zK3mQ7xW2pL5v"' for i in range(40)]
    false = [f"see folder/subfolder/name{i:04d}/filename" for i in range(40)]
    docs = table(spark, [*real, *false, 'password: "9999aB9zK3mQ7xW2pL5v"', "see folder/subfolder/name9999/filename"])
    labels = spark.createDataFrame(
        [(f"{i:04d}aB9zK3mQ7xW2pL5v", 1) for i in range(40)] + [(f"folder/subfolder/name{i:04d}/filename", 0) for i in range(40)]
        + [(None, 1), ("x", None)], "value string, label int")
    found = {r["doc_id"]: r["is_secret"] for r in secret_findings(docs, labels).collect()}
    assert found[80] and not found[81]


def test_short_unspaced_compound_and_dotted_secrets_go(spark):
    token = "ghp_" + "a1B2c3D4e5" * 3
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    mark = "[secret]"
    lines = {
        'password: "Hunter2!x"': f'password: "{mark}"', "pwd=Hunter2!x go": f"pwd={mark} go",
        f"API_TOKEN={token}": f"API_TOKEN={mark}", f'db_password = "{token}"': f'db_password = "{mark}"',
        f'aws_secret_access_key = "{token}"': f'aws_secret_access_key = "{mark}"',
        f"client_secret={token}": f"client_secret={mark}", f"accessToken: {token}": f"accessToken: {mark}",
        f"Authorization: Bearer {jwt}": f"Authorization: Bearer {mark}", f"see {jwt}.": f"see {mark}.",
        "monkey: banana and keys: two": "monkey: banana and keys: two",
    }
    docs = table(spark, [*lines, *(f"see folder/subfolder/name{i:04d}/filename" for i in range(20))])
    clean = dict(plain(redacted(docs, secret_findings(docs)), "doc_id", "text"))
    assert [clean[i] for i in range(len(lines))] == list(lines.values())


def test_planted_findings_that_no_rule_labels(spark):
    """Contexts the table never shows: the forest decides, alone and among other texts."""
    token = "9fK2mQ7xW2pL5vT8nB3cR6yH1jD4"
    mark = "[secret]"
    phrase = "correct horse battery staple " * 6 + "7"
    long = "eyJhbGciOiJIUzI1NiJ9.eyJ" + "aB3" * 500 + "." + "zX9w" * 700
    secret = {
        f"api key sk-{token}": f"api key {mark}",
        f"the token is {token} today": f"the token is {mark} today",
        "postgres://admin:S3cr3tPw!x@host": f"postgres://admin:{mark}@host",
        f'password = "{phrase}"': f'password = "{mark}"',
        f"got {long} back": f"got {mark} back",
    }
    clean = ["commit 3f786850e387550fdab836ed7e6dc881de23001b landed",
             "md5 checksum d41d8cd98f00b204e9800998ecf8427e", "order number 4994226020900891 came",
             "see folder/subfolder/name0001/filename", "thethorouinhndontiinndonthbletiing is a word"]
    lines = [*secret, *clean]
    want = [*secret.values(), *clean]
    docs = table(spark, lines)
    found = dict(plain(redacted(docs, secret_findings(docs)), "doc_id", "text"))
    assert [found[i] for i in range(len(lines))] == want
    stored = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    more = stored.unionByName(table(spark, lines, [1_000_000 + i for i in range(len(lines))]).select(stored.columns))
    found = dict(plain(redacted(more, secret_findings(more)).where("doc_id >= 1000000"), "doc_id", "text"))
    assert [found[1_000_000 + i] for i in range(len(lines))] == want


def test_known_findings_have_one_candidate_each(spark):
    known = known_findings(spark)
    found = [i for i, in plain(candidates(known, path_col=None), "doc_id")]
    assert found == [i for i, in plain(known, "doc_id")]


def test_nothing_to_find(spark):
    for texts in ([], [None, "", "short words"]):
        docs = table(spark, texts)
        assert secret_findings(docs).collect() == []
        assert plain(redacted(docs, secret_findings(docs)), "text") == sorted([(t,) for t in texts], key=lambda r: (r[0] is not None, r[0]))


def test_plans_stay_small(spark):
    def plan(df):
        return df._jdf.queryExecution().analyzed().toString()

    # Known findings are cases of one expression each for text and label, not one within another.
    known = secrets.known_findings(spark)
    assert plan(known).count("CASE WHEN") == 2
    # The transition table is one literal, not an expression for each of its numbers.
    words = spark.createDataFrame([("window", 3)], "word string, n long")
    features = secrets.with_features(secrets.candidates(known, path_col=None), words, [-4.5] * 784)
    assert "array(-4.5" not in plan(features)
