"""URL verdicts: rules first, then segmented host and path words under multinomial naive Bayes.

Host labels are split at signs and digits; what is left is segmented by the most probable
sequence of words (Viterbi) under a unigram model. The model mixes how often words stand in the
visible text of all pages with a small share for the words of the labelled examples. A page's text
says nothing about the labels of its own host, or each name would be a word for its own sake. Only
counts of words that occur inside some host label are gathered, a label at a time. Words of host
and path are scored by a multinomial naive Bayes model fitted on the labelled examples.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, spread_join, table, written

#: Rules of the query: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: Longest word of the unigram model; share of the examples' words in it; what an unknown word weighs beside a tenth for each letter.
LONGEST, EXAMPLE_SHARE, UNKNOWN = 24, 0.05, 1e-8
#: Smoothing, and the share of allowed hosts before any word is seen.
ALPHA, ALLOWED = 0.1, 0.75
# Words that say nothing.
SILENT = set("www m mobile com net org edu gov info io co uk de fr es it en example html htm php asp aspx index page ref amp http https".split())
#: Version 2 of the labelled examples: words of names of sites, made up by kind. judged() takes other ones in their place.
EXAMPLES = [
    ("block", line) for line in """cheap pills online pharmacy
buy viagra cialis prescription
discount meds shop
weight loss pills miracle diet
steroids sale
online casino slots jackpot
casino bonus free spins
poker room texas
sports betting odds tips
lottery jackpot winner
bet win cash
payday loan fast cash
instant loans bad credit
debt relief forex signals
crypto doubler invest profit
get rich quick money
adult xxx videos
free porn tube
hot sex cams
nude cam girls
escort service
singles adult dating chat
milf hookup
hentai erotic gallery
spam farm
spam mail bulk sender
seo backlinks farm
link farm directory submit
cheap traffic bot clicks
replica watches rolex
fake bags outlet luxury
counterfeit sneakers outlet
crack keygen serial
warez torrent download
pirate movies free download
nulled scripts cracked
hacked accounts generator
free gift card claim
claim prize
survey reward iphone winner
won prize
phishing login verify account
secure account update verify
virus malware download
trojan exploit kit
scam alert refund claim
hate white power
gore shock videos
drugs weed cocaine shop
vape kratom sale
fake diploma degree buy
essay mill cheap papers
buy followers likes
ads track
ad server tracker
tracking pixel analytics banner
popup ads network
clicks banner exchange
affiliate redirect offer
miracle cure detox
psychic love spell
mlm earn money
unlock phone hack cheats
game cheats hack coins""".splitlines()
] + [
    ("allow", line) for line in """world news daily
local news report
city times
morning post herald
weather forecast
science journal
physics research institute
biology lab
chemistry today
astronomy space
university library
school education
college courses
learning languages
mathematics lectures
museum art
history archive
culture festival
theatre music
classical concerts
photo gallery travel
travel city guide
mountain hiking trails
hotel booking
railway timetable
garden recipes
farm organic food
family farm market
cooking kids
bread baking blog
health clinic
doctor hospital
dental care
mental health help
cancer research fund
football club
sport results
running cycling
chess federation
yoga studio
software developer docs
open source code
data engineering blog
linux forum
web design
public library
book review
reading group
poetry writers
children stories
government services
law review
tax office
city council
election results
economy market
bank branch
insurance advice
job board careers
company about contact
house home
furniture makers
car repair
bicycle shop
pet care
bird watching
gardening club
community forum
charity volunteers
church choir
my blog
team project""".splitlines()
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host + path) and its verdict; nulls if none does. A rule list is small and fixed."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    fits = [(host == F.lit(h)) | host.endswith("." + h) for _, h, _ in ordered]
    fits = [f & path.startswith(p) for f, (_, _, p) in zip(fits, ordered, strict=True)]
    first = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)])
    return first([h + p for _, h, p in ordered]), first([v for v, _, _ in ordered])


def words_of(examples) -> list[str]:
    return sorted({w for _, line in examples for w in line.split()})


def segment(label: str, counts: dict[str, int], total: int, known: frozenset = frozenset()) -> list[str]:
    """The most probable words of a run of letters, under counts of words in texts and the words of the examples; unknown words cost ten times more with each letter. Ties take the longer last word."""
    best, back = [0.0], [0]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            word = label[start:end]
            p = (1 - EXAMPLE_SHARE) * counts.get(word, 0) / max(1, total) + EXAMPLE_SHARE * (word in known) / max(1, len(known))
            options.append((best[start] + (math.log(p) if p else math.log(UNKNOWN) - math.log(10.0) * (end - start)), -start))
        score, start = max(options)
        best.append(score)
        back.append(-start)
    out, end = [], len(label)
    while end:
        out.append(label[back[end] : end])
        end = back[end]
    return out[::-1]


class Bayes:
    """Multinomial naive Bayes on labelled lines of words; words of no example and silent words count for nothing."""

    def __init__(self, examples=EXAMPLES):
        n: dict[str, dict[str, int]] = {"allow": {}, "block": {}}
        for verdict, line in examples:
            for w in line.split():
                n[verdict][w] = n[verdict].get(w, 0) + 1
        words = {*n["allow"], *n["block"]}
        sums = {k: sum(c.values()) + ALPHA * len(words) for k, c in n.items()}
        of = lambda k, w: math.log((n[k].get(w, 0) + ALPHA) / sums[k])
        self.odds = {w: of("block", w) - of("allow", w) for w in words}
        self.prior = math.log((1 - ALLOWED) / ALLOWED)

    def log_odds(self, words) -> float:
        """Over 0: block."""
        return self.prior + sum(self.odds.get(w, 0.0) for w in words if w not in SILENT)


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): runs of a-z in the visible text of pages (host, html). Scripts, styles, comments, markup and names with dots in them are left out, and so are the labels of a page's own host."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    text = F.regexp_replace(F.lower(text), r"[\w-]+(?:\.[\w-]+)+", " ")
    found = F.regexp_extract_all(text, F.lit(rf"(?<!\p{{L}})[a-z]{{1,{LONGEST}}}(?!\p{{L}})"), F.lit(0))
    own = F.regexp_extract_all("host", F.lit("[a-z]+"), F.lit(0))
    words = pages.select(found.alias("words"), own.alias("own")).select(F.explode(F.filter("words", lambda w: ~F.array_contains("own", w))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def segmented(labels: DataFrame, counts: DataFrame, examples=EXAMPLES) -> DataFrame:
    """(label, words) of a written table of distinct labels (runs of a-z). Pieces of one letter are no words."""
    total, known = counts.agg(F.sum("n")).first()[0] or 0, frozenset(words_of(examples))
    pieces = F.expr(f"explode(array_distinct(flatten(transform(sequence(1, length(label)), i -> transform(sequence(2, greatest(2, least({LONGEST}, length(label) - i + 1))), k -> substring(label, i, k))))))")
    cut = written(labels.select("label", pieces.alias("word")).where(F.length("word") > 1), "pieces")
    found = spread_join(cut, counts, "word", cut.groupBy("word").agg(F.count("*").alias("n"))).where("n IS NOT NULL")
    # a label has at most its length times LONGEST pieces
    found = labels.join(found.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts")), "label", "left")
    return mapped(found, ["label"], ["label", "counts"], {"words": "array<string>"}, lambda ls, cs: [[segment(x, dict(c or []), total, known) for x, c in zip(ls, cs, strict=True)]])


def judged(pages: DataFrame, rules=RULES, examples=EXAMPLES) -> DataFrame:
    """page_id, host, path, rule, verdict, host_words, score for each row of pages (page_id, url, html).

    A null url, or one without ://, has empty host and path; no rule fits an empty path. Without a
    word that the examples know the verdict is allow. Repeated rows are judged alike, null html adds
    no words, no rows give no rows. Other columns are not read. score: log odds of block. examples:
    a list of (verdict, words), of bounded length.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    hosts = written(rows.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    runs = written(hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit("[a-z]+"), F.lit(0))).alias("at", "label")), "runs")
    labels = written(runs.groupBy("label").agg(F.count("*").alias("n")), "labels")
    words = written(segmented(labels.select("label"), written(word_counts(pages.select(host.alias("host"), "html")), "words"), examples), "segmented")
    of_host = spread_join(runs, words, "label", labels).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("parts"))  # labels of one host
    of_host = of_host.select("host", F.flatten("parts.words").alias("host_words"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    joined = spread_join(rows.withColumn("rule", rule).withColumn("ruled", verdict), written(of_host, "segments"), "host", hosts)
    model = Bayes(examples)

    def score(host_words, paths):
        return [[model.log_odds([*(h or []), *re.findall("[a-z]+", p.lower())]) for h, p in zip(host_words, paths, strict=True)]]

    out = mapped(joined, ["page_id", "host", "path", "rule", "ruled", "host_words"], ["host_words", "path"], {"score": "double"}, score)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), F.array_join("host_words", " ").alias("host_words"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pages table."""
    return judged(table(spark, sf_dir, "pages"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of the verdicts: parts of urls and the rules that decide them."""
    found = op6_url_filter(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


URL_RULES_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT DISTINCT host, path, rhost || rpath AS rule, verdict FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC) = 1)
SELECT page_id, u.host, u.path, rule, verdict AS ruled FROM u LEFT JOIN fits ON u.host = fits.host AND u.path = fits.path
"""
