"""Generated, minified, vendored and data files among source files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm import wordblocks as wb
from loomwright.session import durable

STRING = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`', re.S)
COMMENT = re.compile(r"/\*.*?\*/|//[^\n]*", re.S)
LEADING = re.compile(r"\s*((?:(?:/\*.*?\*/|//[^\n]*)\s*)+)", re.S)
TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|\S")
NAME = re.compile(r"[A-Za-z_$][\w$]*")
OBFUSCATED = re.compile(r"_0x[0-9a-fA-F]+$")
# Reserved words and literals of the language.
RESERVED = frozenset("function return if else for while do var let const new this switch case break continue default throw try catch finally of in instanceof typeof void delete null true false undefined class extends super export import from module exports async await yield".split())
CONTROL = frozenset("function return if else for while do switch case throw try catch class => yield await".split())
GENERATED_NOTE = re.compile(r"\b(?:auto-?\s?generated|@?generated\s+(?:by|from|file|code|with|using)|machine[- ](?:written|generated)|do not (?:edit|modify)|(?:changes|edits) will be (?:lost|overwritten)|code generator)\b|@generated", re.I)
LICENCE_NOTE = re.compile(r"\(c\)|copyright|\blicen[cs]ed?\b|@license|@preserve", re.I)
OWN_NOTE = re.compile(r"this project|this repository|this file", re.I)
VENDOR_FOLDER = r"(?i)(^|/)(node_modules|bower_components|third[_-]?party|vendor)/"
LEAST_SHARE = 0.5  # of a file's rare lines in one file of another repository, and the other way round
LEAST_FUNCTIONS = 2  # that both files have, unless they have one name: one function is borrowed, a file is copied
RARE_SHARE, RARE_ANYWAY = 1e-5, 3  # a line is rare up to this share of all functions, or this number of them
LEAST_VOTES = 0.1  # of a file's rare lines have to nominate a file that it is compared with first
MORE_ROWS = 3  # times the rows that the fewest lines to look a partner up by cost
SYNTHETIC_SHARE = 0.3  # of a snippet's names without a letter
SHAPE_SHARE, SHAPE_LINES, SHAPE_TOKENS = 0.75, 5, 12  # of a snippet's tokens in lines of one shape; how many, how long


def code_kind(code: str) -> str | None:
    """generated, minified, data or licensed, from the composition of one snippet's tokens; None if written by hand.

    Notes count in the leading comment alone, not in strings and bodies, where code about such files has them.
    """
    leading = LEADING.match(code)
    note = leading.group(1) if leading else ""
    if GENERATED_NOTE.search(note):
        return "generated"
    body = COMMENT.sub(" ", STRING.sub('""', code))
    lines = [TOKEN.findall(line) for line in body.split("\n")]
    if repeated_share(lines) >= SHAPE_SHARE:
        return "data" if not any(t in CONTROL for line in lines for t in line) and "(" not in body else "generated"
    tokens = [t for line in lines for t in line]
    names = [t for t in tokens if NAME.match(t) and t not in RESERVED]
    # names without a letter: counters of a program that prints code
    if sum(not any(c.isalpha() for c in n) and len(n) > 1 for n in names) > SYNTHETIC_SHARE * len(names):
        return "generated"
    visible = max(1, sum(map(len, code.split())))
    spaces = (len(code) - visible) / max(1, len(code))
    short = sum(len(n) <= 2 or bool(OBFUSCATED.match(n)) for n in names)
    if len(names) >= 12 and short > 0.4 * len(names) and spaces < 0.1:
        return "minified"
    literals = [m.group() for m in STRING.finditer(code)]
    numbers = [t for t in tokens if t[0].isdigit()]
    written = sum(map(len, literals)) + sum(map(len, numbers))
    acting = sum(t in CONTROL for t in tokens) + body.count("=>")
    if not acting and (written > 0.5 * visible or len(literals) + len(numbers) >= 12 and written > 0.3 * visible):
        return "data"
    if LICENCE_NOTE.search(note) and not OWN_NOTE.search(note):
        return "licensed"
    return None


def repeated_share(lines: list[list[str]]) -> float:
    """The share of all tokens that the lines of the heaviest shape have; 0 if there are less than SHAPE_LINES of them.

    A line's shape is its tokens with every name that isn't reserved, and every number, made one. People vary what
    they write; what a program prints from a list repeats one shape. Lines of three tokens or less don't count, and
    shapes of less than SHAPE_TOKENS, like lists of plain calls, which people write too, give 0.
    """
    shapes: dict[tuple[str, ...], int] = {}
    total = 0
    for line in lines:
        if len(line) > 3:
            shape = tuple(t if t in RESERVED else "a" if NAME.match(t) else "0" if t[0].isdigit() else t for t in line)
            shapes[shape] = shapes.get(shape, 0) + 1
            total += len(shape)
    weight, count, size = max(((len(s) * n, n, len(s)) for s, n in shapes.items()), default=(0, 0, 0))
    return weight / total if count >= SHAPE_LINES and size >= SHAPE_TOKENS else 0.0


def _line_hashes(code: str) -> list[str]:
    """Lines without outer and repeated blanks, those with less than three words left out."""
    lines = (" ".join(line.split()) for line in code.split("\n"))
    return [line for line in lines if len(NAME.findall(line)) >= 3]


def _read_code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, values, at = [], [], [0]
        for code in batch.column("code").to_pylist():
            kinds.append(code_kind(code) if code else None)
            lines = _line_hashes(code) if code else []
            values.extend(lines)
            at.append(len(values))
        hashed = _hash_lines(values)
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashed))
        yield pa.RecordBatch.from_arrays([batch.column("content_key"), pa.array(kinds, pa.string()), lists], names=["content_key", "kind", "lines"])


def _hash_lines(lines: list[str]) -> np.ndarray:
    """64-bit hashes of lines by all their characters."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return wb.mix(np.fromiter((digest(line) for line in lines), dtype=np.uint64, count=len(lines))).view(np.int64)


def foreign_files(occurrences: DataFrame, contents: DataFrame, holders: DataFrame) -> DataFrame:
    """(occ_key, reason) of the occurrences in files that nobody wrote by hand in their repository.

    occurrences: (occ_key, content_key, path, symbol). contents: (content_key, code). holders: (repo, occ_key): which
    repositories hold an occurrence; one that none holds is looked at by its own content and path. A file is a path of
    a repository, with all its occurrences of all times; if one of them gives the file away, all count, and an
    occurrence in several repositories counts if any of its files does. reason is the first of generated, minified,
    data, vendored that holds. NULL or missing code tells nothing; a NULL path or symbol is a value of its own; rows
    with a NULL occ_key are left out. Repeated rows count once. Other columns are not looked at. Empty tables give no rows.

    Method: an inverted index of line hashes over all files. A line is rare if few of all functions have it
    (RARE_SHARE); what everybody writes is not. A file is vendored if LEAST_SHARE of its rare lines are in a partner, any
    file of another repository, and LEAST_SHARE of the partner's in it, in LEAST_FUNCTIONS functions or under one file name: edits lower
    that only by the lines they touch, and single functions borrowed for a file of one's own don't reach it. Only files that
    share so many lines with other repositories are looked at. Each of their lines nominates two of them, of different
    repositories, and so do files of one name; those that LEAST_VOTES of its lines nominate are compared with a file
    exactly, which settles most copies. The rest is compared with every file that has enough of its rarest shared lines, as
    many as no partner can be without, so no partner is missed. A file is
    vendored too if it opens with somebody's licence note or lies in a folder for foreign code. All other files are told
    by the composition of their tokens (code_kind).

    Scale: contents are read once. Copies of a library nominate the same few files, so a library that a third of all
    repositories hold costs two rows a line and copy. Only files that these don't settle are paired through lines, with
    partners of a fitting size, equal ones once: files that are made of several popular ones cost a row for each version of these.
    """
    read = contents.select("content_key", "code").filter("content_key IS NOT NULL").dropDuplicates(["content_key"]).mapInArrow(_read_code, "content_key string, kind string, lines array<long>")
    read = durable(read)
    known = occurrences.select("occ_key", "content_key", "path", "symbol").filter("occ_key IS NOT NULL").dropDuplicates(["occ_key"])
    held = holders.select("repo", "occ_key").distinct()
    placed = durable(known.join(held, "occ_key", "left").select("occ_key", "content_key", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("symbol", F.lit("")).alias("symbol")))

    uses = placed.select("content_key", "repo", "path", "symbol").distinct()
    lines = durable(uses.join(read.select("content_key", F.explode("lines").alias("line")), "content_key").select("repo", "path", "symbol", "line").distinct())
    foreign = _copied(lines).select("repo", "path", F.lit("vendored").alias("reason"))

    by_content = placed.join(read.select("content_key", "kind").filter("kind IS NOT NULL"), "content_key").select("repo", "path", F.when(F.col("kind") == "licensed", "vendored").otherwise(F.col("kind")).alias("reason"))
    by_folder = placed.filter(F.col("path").rlike(VENDOR_FOLDER)).select("repo", "path", F.lit("vendored").alias("reason"))
    order = F.when(F.col("reason") == "generated", 1).when(F.col("reason") == "minified", 2).when(F.col("reason") == "data", 3).otherwise(4)
    files = foreign.unionByName(by_content).unionByName(by_folder).groupBy("repo", "path").agg(F.min(F.struct(order.alias("o"), "reason")).alias("r"))
    return placed.select("occ_key", "repo", "path").join(files, ["repo", "path"]).groupBy("occ_key").agg(F.min("r").alias("r")).select("occ_key", F.col("r.reason").alias("reason"))


def _copied(lines: DataFrame) -> DataFrame:
    """(repo, path) of the files whose rare lines are in a file of another repository, and the other way round."""
    functions = F.greatest(F.lit(RARE_ANYWAY), F.ceil(RARE_SHARE * F.lit(lines.select("repo", "path", "symbol").distinct().count())))
    rare = lines.select("line", "symbol").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("symbols")).filter(F.col("symbols") <= functions).select("line")
    name = F.xxhash64(F.substring_index("path", "/", -1))
    held = durable(lines.join(rare, "line").select("repo", "path", F.xxhash64("repo", "path").alias("file"), F.xxhash64("repo").alias("home"), name.alias("name"), F.xxhash64("symbol").alias("symbol"), "line"))
    placed = durable(held.filter("repo != ''").select("file", "home", "name", "line").distinct())

    # lines that another repository has: a file without LEAST_SHARE of them has no partner
    of_line = placed.groupBy("line").agg(F.min("home").alias("lo"), F.max("home").alias("hi"), F.count(F.lit(1)).alias("files"))
    shared = durable(held.join(of_line, "line").filter("lo != home OR hi != home").select("file", "home", "name", "symbol", "line", "files"))
    sizes = held.groupBy("file", "repo", "path").agg(F.count(F.lit(1)).alias("n"))
    of_file = shared.groupBy("file").agg(F.count(F.lit(1)).alias("c"), (F.min("symbol") != F.max("symbol")).alias("several"))
    opened = durable(of_file.join(sizes, "file").filter(F.col("c") >= LEAST_SHARE * F.col("n")))
    asked = durable(shared.join(opened.select("file", "n", "c", "several", (F.col("repo") != "").alias("placed")), "file"))
    partners = durable(placed.groupBy(F.col("file").alias("partner"), F.col("home").alias("partner_home"), F.col("name").alias("partner_name")).agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("line")).alias("x"), F.bit_xor(F.xxhash64("line", F.lit(1))).alias("y")))

    def proven(pairs: DataFrame) -> DataFrame:
        """(file, repo, path) of the files that their partners in pairs (file, partner), compared exactly, show to be copies."""
        there = placed.select(F.col("file").alias("partner"), "line")
        of_function = asked.select("file", "symbol", "line").join(pairs, "file").join(there, ["partner", "line"]).groupBy("file", "partner", "symbol").agg(F.count(F.lit(1)).alias("s"))
        compared = of_function.groupBy("file", "partner").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("functions"))
        compared = compared.join(partners, "partner").join(opened, "file")
        same = F.col("partner_name") == F.xxhash64(F.substring_index("path", "/", -1))
        whole = (F.col("s") >= LEAST_SHARE * F.col("n")) & (F.col("s") >= LEAST_SHARE * F.col("m")) & ((F.col("functions") >= LEAST_FUNCTIONS) | same)
        # what no repository holds may be a version of the one file it is in
        needed = F.col("homes") >= F.when(F.col("repo") == "", 2).otherwise(1)
        return compared.filter(whole).groupBy("file", "repo", "path").agg(F.count_distinct("partner_home").alias("homes")).filter(needed).select("file", "repo", "path")

    def nominated(on: list[str]) -> DataFrame:
        """Pairs of a file and one that LEAST_VOTES of its lines nominate: of all that have the line, or of those of its name."""
        ends = asked.filter("placed").select("file", "home", "name", "line").groupBy(*on).agg(F.min_by("file", "home").alias("lo"), F.max_by("file", "home").alias("hi"), F.min("home").alias("lo_home"), F.max("home").alias("hi_home")).filter("lo_home != hi_home")
        ends = ends.select(*on, F.explode(F.array(F.struct(F.col("lo").alias("partner"), F.col("lo_home").alias("there")), F.struct(F.col("hi").alias("partner"), F.col("hi_home").alias("there")))).alias("e")).select(*on, "e.*")
        votes = asked.join(ends, on).filter("there != home").groupBy("file", "n", "partner").agg(F.count(F.lit(1)).alias("votes"))
        return votes.filter(F.col("votes") >= LEAST_VOTES * F.col("n")).select("file", "partner")

    settled = durable(proven(nominated(["line"]).union(nominated(["line", "name"])).distinct()))

    # The rest is looked up without a bound. LEAST_SHARE of the lines can't be in a partner that has none of all but
    # as many, less one, of the shared ones; with more of these looked up, it must have as many more. Those that the
    # fewest files have come first, more of them while they don't multiply the rows.
    rest = asked.join(settled.select("file"), "file", "left_anti").withColumn("least", F.col("c") - F.ceil(LEAST_SHARE * F.col("n")) + 1)
    order, of_one = Window.partitionBy("file").orderBy("files", "line", "symbol"), Window.partitionBy("file")
    rest = rest.withColumn("place", F.row_number().over(order)).withColumn("cost", F.sum("files").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rest = rest.withColumn("least_cost", F.max(F.when(F.col("place") == F.col("least"), F.col("cost"))).over(of_one))
    looked = rest.filter((F.col("place") <= F.col("least")) | (F.col("cost") <= MORE_ROWS * F.col("least_cost")))
    looked = durable(looked.withColumn("must", F.count(F.lit(1)).over(of_one) - F.col("least") + 1).select("file", "home", "name", "line", "c", "several", "must"))
    # files of one name with the same lines are alike as partners: the first and the last repository's stand for all
    alike = partners.groupBy("x", "y", "m", "partner_name").agg(F.min_by("partner", "partner_home").alias("lo"), F.max_by("partner", "partner_home").alias("hi"), F.min("partner_home").alias("lo_home"), F.max("partner_home").alias("hi_home"))
    stand = alike.select("m", "partner_name", F.explode(F.array_distinct(F.array(F.struct(F.col("lo").alias("partner"), F.col("lo_home").alias("there")), F.struct(F.col("hi").alias("partner"), F.col("hi_home").alias("there"))))).alias("e")).select("m", F.col("partner_name").alias("name"), "e.*")
    there = durable(placed.select(F.col("file").alias("partner"), "line").join(looked.select("line").distinct(), "line", "left_semi").join(stand, "partner"))
    fits = (F.col("there") != F.col("home")) & (LEAST_SHARE * F.col("m") <= F.col("c"))
    # a file with one shared function needs a partner of its name
    by_line = looked.filter("several").drop("name").join(there, "line").filter(fits)
    by_name = looked.filter("NOT several").join(there, ["line", "name"]).filter(fits)
    hits = by_line.select("file", "partner", "must").union(by_name.select("file", "partner", "must")).groupBy("file", "partner", "must").agg(F.count(F.lit(1)).alias("s"))
    found = proven(hits.filter("s >= must").select("file", "partner"))
    return settled.union(found).select("repo", "path")
