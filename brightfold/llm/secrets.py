"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame and SQL functions only.

A candidate is a run of 16 or more of the characters that credentials are made of, with a digit. Its features are length,
shares and transitions of character classes, common letter pairs, coverage by dictionary words, the words beside it and the
path it stands in. The forest is trained on a table of labelled findings (findings() makes one by rule; any table of its
columns will do) of fixed size, and its trees become one SQL expression, so scoring is a projection of each row without a shuffle.

Defined results: null or empty text has no finding; a null path is an empty one; a text that repeats a candidate has a
finding for each place; equal rows give equal findings; an empty table gives none; redact() keeps every row and column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN = r"A-Za-z0-9_\-+/="
CANDIDATE = rf"(?<![{RUN}])(?=[A-Za-z_\-+/=]*[0-9])[{RUN}]{{16,}}"
REDACTED = "[SECRET]"
#: Words that identifiers and placeholders are made of, words that name a credential, and words that name something else.
DICTIONARY = "about account address after all api application array auth before build cache change class client code column common config content count create current data date debug default delete demo description device document domain dummy email enable entry error event example export false fake field file filter find first folder format from function get group handler head height hello here home image index info input insert integer item john key label last layout length level library line link list local log main manager map max memory message method min mock model module name network next node none null number object option order output page param parent password path pipeline placeholder point post process project query queue read record remote replace request response result return root sample schema search section select server service session set size sort source start state static status stream string sum system table target temp test text the this time title token tree true type undefined unit update upload url user value version view web width window word world write xml your".split()
NAMING = "token secret password passwd pwd apikey api_key access_key auth bearer credential private_key client_secret signing".split()
OTHERWISE = "commit sha sha1 sha256 md5 checksum digest integrity etag revision id uuid guid order isbn version hash build phone card account date".split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()

FEATURES = ("length", "digits", "uppers", "symbols", "switches", "hexadecimal", "vowels", "pairs", "distinct", "dictionary", "repeats", "prefixed", "named", "assigned", "quoted", "otherwise", "test_path", "config_path")


def _share(c: Column, pattern: str) -> Column:
    """The share of c's characters in the matches of a pattern."""
    n = F.greatest(F.length(c), F.lit(1))
    return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))) / n


def features(c: Column, left: Column, right: Column, path: Column) -> list[Column]:
    """FEATURES of a candidate with some text on its left and right, as doubles."""
    low, before = F.lower(c), F.lower(left)
    near = F.regexp_extract(before, r"([a-z_0-9]+)[^a-z_0-9]*$", 1)
    words = sorted(DICTIONARY, key=len, reverse=True)
    beside = lambda names: rf"(?:^|[^a-z]|_)(?:{'|'.join(names)})s?$"
    columns = [
        F.least(F.length(c), F.lit(256)),
        _share(c, "[0-9]"),
        _share(c, "[A-Z]"),
        _share(c, "[^A-Za-z0-9]"),
        F.length(F.regexp_replace(c, r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])", "#")) / F.length(c) - 1,
        low.rlike("^[0-9a-f]+$"),
        _share(low, "[aeiou]"),
        _share(low, f"(?:{'|'.join(PAIRS)})"),
        F.size(F.array_distinct(F.split(c, ""))) / F.least(F.length(c), F.lit(62)),
        _share(low, f"(?:{'|'.join(words)})"),
        _share(low, r"(.)\1{2,}|0123|1234|2345|3456|4567|5678|6789|abcd"),
        c.rlike("^(?:AKIA|ASIA|gh[pousr]_|sk[-_]|pk_live|xox[abp]-|eyJ|AIza|glpat-|npm_)"),
        near.rlike(beside(NAMING)),
        before.rlike(r"[=:]\s*[\"']?$"),
        before.rlike(r"[\"']$") & right.rlike(r"^[\"']"),
        near.rlike(beside(OTHERWISE)),
        F.lower(path).rlike("test|example|sample|mock|fixture|docs?/"),
        F.lower(path).rlike(r"\.env|conf|secret|credential|\.ya?ml|\.ini|prod|deploy"),
    ]
    return [x.cast("double").alias(n) for x, n in zip(columns, FEATURES)]


def findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Labelled findings made by rule: candidate, left, right, path and label, half of them secrets."""
    i = F.col("id")
    pick = lambda names, salt: F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(names))) + 1).cast("int"))
    hexa = lambda n, salt: F.substring(F.sha2(F.concat_ws("|", i, F.lit(salt)), 512), 1, n)
    mixed = lambda n, salt: F.substring(F.regexp_replace(F.base64(F.unhex(hexa(128, salt))), "[\r\n]", ""), 1, n)
    plain = lambda n, salt: F.substring(F.regexp_replace(mixed(84, salt), "[+/=]", ""), 1, n)
    digits = lambda n, salt: F.substring(F.regexp_replace(hexa(128, salt), "[a-f]", ""), 1, n)
    word = lambda salt: pick(DICTIONARY, salt)
    secret = [hexa(40, "a"), hexa(32, "b"), mixed(40, "c"), F.concat(F.lit("AKIA"), F.upper(plain(16, "d"))), F.concat(F.lit("ghp_"), plain(36, "e")), F.concat(F.lit("sk_live_"), plain(28, "f")), F.concat(F.lit("eyJ"), plain(60, "g")), F.concat(plain(18, "h"), digits(2, "h")), hexa(64, "i"), F.upper(hexa(40, "j"))]
    harmless = [
        F.concat_ws("-", hexa(8, "a"), hexa(4, "b"), hexa(4, "c"), hexa(4, "d"), hexa(12, "e")),
        hexa(40, "f"),
        digits(16, "g"),
        F.concat_ws("_", word("h"), word("i"), word("j"), word("k"), digits(2, "l")),
        F.concat_ws("/", word("m"), word("n"), word("o"), F.concat(word("p"), digits(2, "q"))),
        F.concat(pick(["your_token_here_", "xxxxxxxxxxxxxxxx", "changeme_example_", "00000000000000000", "EXAMPLEKEYEXAMPLE"], "r"), digits(3, "s")),
        F.concat_ws("-", F.lit("2024"), digits(2, "t"), digits(2, "u"), digits(2, "v"), digits(2, "w"), digits(2, "x")),
        F.concat(F.lit("sha256-"), mixed(43, "y")),
        F.concat(word("z"), word("1"), word("2"), word("3"), digits(1, "4")),
        F.concat(F.lit("/"), hexa(32, "5"), F.lit("/"), word("6")),
    ]
    label = F.pmod(i, F.lit(2))
    nth = F.pmod(F.floor(i / 2), F.lit(10)).cast("int") + 1
    named = F.concat(pick(["", "The ", "my_", "app.", "export "], "7"), pick(NAMING, "8"), pick([" = ", "=", ": ", ":"], "9"), pick(['"', "'", ""], "10"))
    named = F.when(F.pmod(F.xxhash64(i, F.lit("11")), F.lit(6)) == 0, F.upper(named)).otherwise(named)
    other = F.concat(pick(["see ", "the ", "at ", "was ", "", "to of "], "12"), pick([*OTHERWISE, "and", "in", "on", "with", "for"], "13"), pick([" ", ": ", "=", " = ", " #"], "14"), pick(['"', "", ""], "15"))
    # placeholders stand after the same names as secrets do, and some secrets after no name
    left = F.when((label == 1) & (F.pmod(F.xxhash64(i, F.lit("16")), F.lit(12)) > 0), named).when((label == 0) & (nth == 6), named).otherwise(other)
    right = F.when(F.substring(left, -1, 1).isin('"', "'"), F.concat(F.substring(left, -1, 1), F.lit(" "))).otherwise(F.lit(" "))
    path = pick(["src1", "src2", "web", "app/main.py", "deploy/prod.yaml", "README.md", "conf/app.ini"], "17")
    path = F.when((label == 0) & (nth % 3 == 0), pick(["tests/unit.py", "docs/example.md", "src3"], "18")).otherwise(path)
    candidate = F.when(label == 1, F.element_at(F.array(*secret), nth)).otherwise(F.element_at(F.array(*harmless), nth))
    return spark.range(rows).select(candidate.alias("candidate"), left.alias("left"), right.alias("right"), path.alias("path"), label.cast("double").alias("label"))


def train(labelled: DataFrame, trees: int = 20, depth: int = 6, seed: int = 7) -> list[str]:
    """The forest as a SQL expression a tree: each a share of votes over columns named by FEATURES."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled.select("label", *features(F.col("candidate"), F.col("left"), F.col("right"), F.col("path")))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)
    return [tree_sql(t) for t in re.split(r"(?m)^\s*Tree \d+.*\n", model.toDebugString)[1:]]


def tree_sql(tree: str) -> str:
    """A tree of the library's printed form as nested CASE expressions."""
    lines = iter([x.strip() for x in tree.strip().splitlines()])

    def node() -> str:
        line = next(lines)
        if m := re.match(r"Predict: ([\d.E+-]+)", line):
            return f"{m[1]}D"
        m = re.match(r"If \(feature (\d+) <= ([\d.E+-]+)\)", line)
        yes = node()
        next(lines)  # Else
        return f"CASE WHEN {{{FEATURES[int(m[1])]}}} <= {float(m[2])!r}D THEN {yes} ELSE {node()} END"

    return node()


def _scored(docs: DataFrame, forest: list[str], text: Column, path: Column) -> DataFrame:
    """docs with _parts, _found and _scores: the texts between candidates, the candidates and their scores."""
    text, path = F.coalesce(text.cast("string"), F.lit("")), F.coalesce(path.cast("string"), F.lit(""))
    rows = docs.withColumn("_found", F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    rows = rows.withColumn("_parts", F.when(F.size("_found") > 0, F.split(text, CANDIDATE, -1)).otherwise(F.array(text)))
    rows = rows.withColumn("_path", path).withColumn("_near", F.expr("transform(_found, (c, k) -> named_struct('c', c, 'l', right(_parts[k], 60), 'r', left(_parts[k + 1], 20)))"))
    rows = rows.withColumn("_features", F.transform("_near", lambda x: F.struct(*features(x["c"], x["l"], x["r"], F.col("_path")))))
    vote = " + ".join(t.format(**{n: f"f.{n}" for n in FEATURES}) for t in forest)
    return rows.withColumn("_scores", F.expr(f"transform(_features, f -> ({vote}) / {len(forest)})")).drop("_near", "_features", "_path")


def scan(docs: DataFrame, forest: list[str], id_column: str = "doc_id", text_column: str = "text", path_column: str = "source") -> DataFrame:
    """A row for each candidate: doc_id, start and length in characters, candidate, score and is_secret (score of a half or more)."""
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"), F.col(f"`{path_column}`").alias("path"), F.monotonically_increasing_id().alias("row"))
    rows = _scored(rows, forest, F.col("text"), F.col("path")).where(F.size("_found") > 0)
    each = rows.select("row", "doc_id", F.posexplode(F.expr("transform(_found, (c, k) -> named_struct('before', length(_parts[k]), 'candidate', c, 'score', _scores[k]))")).alias("at", "x"))
    each = each.select("row", "doc_id", "at", "x.*")
    so_far = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("before") + F.length("candidate")).over(so_far)
    return each.withColumn("end", end).select("doc_id", (F.col("end") - F.length("candidate")).alias("start"), F.length("candidate").alias("length"), "candidate", "score", (F.col("score") >= 0.5).alias("is_secret"))


def redact(docs: DataFrame, forest: list[str], text_column: str = "text", path_column: str = "source") -> DataFrame:
    """docs with every secret replaced by REDACTED; all rows and columns stay."""
    rows = _scored(docs, forest, F.col(f"`{text_column}`"), F.col(f"`{path_column}`"))
    clean = F.concat(F.expr(f"array_join(transform(_found, (c, k) -> concat(_parts[k], if(_scores[k] >= 0.5, '{REDACTED}', c))), '')"), F.element_at("_parts", -1))
    changed = F.exists("_scores", lambda x: x >= 0.5)
    text = F.col(f"`{text_column}`")
    return rows.withColumn(text_column, F.when(changed, clean).otherwise(text)).drop("_found", "_parts", "_scores")
