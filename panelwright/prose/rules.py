"""Rules for the document checks: defaults, and a reader for rule files of the same shape."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Rule:
    re: str
    why: str
    instead: str
    severity: str = "error"
    case_sensitive: bool = False


@dataclass(frozen=True)
class Limits:
    sentence_words: int = 45
    em_dashes: int = 2
    paren_asides: int = 2
    closing_words: int = 7
    closing_sentences: int = 3
    hyperparameters: int = 3
    figure_repeats: int = 2


# Setting names, opening verbs and product words the patterns below list.
_SETTINGS = (
    "lr|learning[ _-]?rate|batch[ _-]?size|per_device_train_batch_size|gradient[ _-]?accumulation(?:[ _-]?steps)?"
    "|grad[ _-]?accum|num_train_epochs|max_steps|max_epochs|warmup(?:[ _-]?(?:steps|ratio))?|weight[ _-]?decay|dropout"
    "|threshold|temperature|top[ _-]?[pk]|seed|max[ _-]?(?:length|len|tokens)|hidden[ _-]?size|num[ _-]?layers"
    "|beam[ _-]?size"
)
_AMOUNT = r"\$?\d[\d.,]*(?:e[+-]?\d+)?"
HYPERPARAMETER = (
    rf"\b[a-z_]*\w*\s*=\s*{_AMOUNT}|\b(?:{_SETTINGS})\b\s*(?:of|=|:|at|to)?\s*{_AMOUNT}"
    rf"|(?<![\w.]){_AMOUNT}\s*(?:{_SETTINGS})\b"
)
HEADLINE_ACTIVITY = (
    r"^(?:I|We)\s+(?:fine-tuned|fine tuned|finetuned|built|trained|wrote|made|shipped|ran|used|tried|spent|set up"
    r"|created|scraped|labeled|labelled|deployed|added|migrated|rewrote|implemented|automated|taught)\b"
)
VERSION_PREFIX = (
    r"\b(?:v|version|Gemini|GPT|Claude|Qwen|Llama|Mistral|GLiNER|DeBERTa|Python|Node(?:\.js)?|Next(?:\.js)?|React"
    r"|TypeScript|Vue|Angular|Windows|iOS|Android|macOS|Ubuntu|Debian|CUDA|PyTorch|TensorFlow)[ -]?$"
)
FIGURE = (
    "(?<![\\w.])(?:[+\u2212-]?\\$?|\\$[+\u2212-]?)\\d+(?:,\\d{3})*(?:\\.\\d+)?(?:e[+-]?\\d+\\b)?(?:%|[KMBk]\\b)?"
)

# Phrases to avoid, why, and what to write, in the published order.
BANNED = (
    Rule(r"\b(sales|marketing|GTM|go-to-market|no-call)\s+motion\b",
         "consulting jargon; a reader outside B2B SaaS has to guess",
         'say the concrete activity: "calls and demos", "cold outreach", "selling by phone"'),
    Rule(r"\bthe\s+(perfect|right|wrong|exact)\s+shape\b",
         "shape metaphor with no referent",
         'name the properties: "published its price, self-serve signup, under $200/mo"'),
    Rule(r"\b[a-z]+-shaped\b",
         "coined compound adjective the reader has to decode",
         "describe the thing plainly"),
    Rule(r"\bthe\s+(opaque|silent|invisible|quiet|fat|thin)\s+(majority|minority|middle|tail|layer|cohort)\b",
         "abstract noun phrase standing in for a number",
         'give the count: "the 433 companies with no published price"'),
    Rule(r"\bthe\s+long\s+tail\b",
         "borrowed term; fine once if the sentence around it is concrete",
         "name what is in the tail", "warn"),
    Rule(r"\bshelf[- ]ranked\b|\bshelf\s+ranked\s+by\b",
         "metaphor doing load-bearing work",
         '"a list ordered by installs and reviews"'),
    Rule(r"\bcard-swipe\s+range\b",
         "coinage; the number is clearer than the label",
         '"cheap enough to put on a credit card ($15-200/mo)"'),
    Rule(r"\bpull\s+channel\b|\bdistribution\s+surface\b|\bwedges?\b",
         "startup jargon",
         "say where the customers actually come from"),
    Rule(r"\bCTAs?\b",
         "startup jargon; the reader sees a button, not an acronym",
         '"the \\"book a demo\\" button", or name the link', case_sensitive=True),
    Rule(r"\bmoats?\b",
         "VC shorthand; fine in a pitch deck, opaque in an essay",
         '"what actually stops a competitor", or name it: "switching costs"'),
    Rule(r"\bleverage(d|s|ing)?\b",
         "verb-as-jargon",
         '"use"'),
    Rule(r"\b(delve|delves|delving)\b",
         "LLM tell",
         '"look at"'),
    Rule(r"\b(landscape|realm|tapestry|ecosystem of|paradigm|synergy|synergies)\b",
         "LLM tell / filler abstraction",
         "name the actual thing"),
    Rule(r"\bunderscor(es|ing)\s+(the|how|that|why|a|an|its|our|their)\b"
         r"|\b(highlights the importance|testament to|speaks volumes)\b",
         "LLM tell",
         "state the point directly"),
    Rule(r"\b(seamless|seamlessly|robust|holistic|comprehensive|cutting-edge|state-of-the-art|game-?changer"
         r"|revolutionize[sd]?|elevate[sd]?|harness(es|ed|ing)?\s+(the|its|our|their)|showcase[sd]?|foster(s|ed|ing)?"
         r"|streamline[sd]?|unlock(s|ed|ing)?\s+value)\b",
         "marketing filler",
         "delete, or give the specific benefit"),
    Rule(r"\b(furthermore|moreover|additionally,|in conclusion|it('|\u2019)s worth noting|it is important to note"
         r"|at the end of the day|that being said)\b",
         "LLM connective tissue",
         "delete; start the sentence with its content"),
    Rule(r"\bnot\s+(only|just)\b[^.]{0,60}\bbut\s+also\b",
         "LLM sentence template",
         "two plain sentences"),
    Rule(r"\bin\s+today('|\u2019)s\s+\w+",
         "LLM opener",
         "delete"),
    Rule(r"\b(crucial|pivotal|meticulous(ly)?|myriad|plethora|nuanced)\b",
         "LLM vocabulary",
         '"important", "careful", "many" \u2014 or delete'),
    Rule(r"\bdeep\s+dive\b|\bdouble\s+down\b|\bmove\s+the\s+needle\b|\bfirst\s+principles\b",
         "business cliche",
         "say what you did"),
    Rule(r"\bsurfaced?\s+(a|an|the|two|three)\b",
         '"surface" as a verb reads like a product spec',
         '"turned up", "found"'),
    Rule(r"\b(a|an|the|one|some)\s+(frontier|general(-purpose)?|mid-tier|major|leading|popular|well-known|commodity"
         r"|stronger|large|big)\s+(cloud\s+)?(LLM|model|GPU|library|vendor|provider|framework|zero-shot\s+\w+\s+model)\b",
         "anonymised noun; the reader is told a thing exists but not what it is",
         'name it: "Gemini 3.1 Pro", "a Tesla T4", "GLiNER large v2.5"'),
    Rule(r"\bAcme\b|\bin a (\w+[- ])?niche\b|\ba (consumer|hobbyist|specialist)[- ]\w+ niche\b"
         r"|\bthe site (the|this) \w+ feeds\b",
         "the domain has been scrubbed out; a write-up that will not say what it is about reads as evasive",
         'say the real thing: "knife brands on r/chefknives", "Benchmade 940", "New Knife Day"'),
    Rule(r"\b[Aa] (site|product|company|tool|app|project|service|business) (I|we) (run|own|built|work (on|with))\b"
         r"|(^|[.!?]\s+)The site('s\b| (?!is\b|this\b|that\b))",
         "a name was deleted and a placeholder put in its slot; the sentence still has the shape of the sentence that"
         " named it",
         "rewrite the sentence so it does not need the name at all, or name the thing", case_sensitive=True),
    Rule(r"\b(the honest (fix|answer|version|take|number)|genuinely"
         r"|the (actual|real) (product|lesson|point|problem|work|cost)|the (lesson|thing) I actually"
         r"|actually (took|matters|moved)|the thing that (moved|made|mattered))\b",
         "staged candour: a model announcing that it is about to be frank",
         "state the fact without the drumroll"),
    Rule(r"\b(nobody (warns|tells) you( about)?|the bug that ate|worth writing down|what generalizes|what to copy"
         r"|key takeaways|lessons learned)\b",
         "headline template; every AI write-up has one of these headings",
         'a plain heading that says what the section contains: "Tokenizing spans", "Runs 1 to 5 failed"'),
    Rule(r"\b(a rounding error next to|is (essentially|effectively|basically) free|is (just )?electricity"
         r"|is decorative|silent success|are the actual product|the expensive kind|the dangerous failure mode"
         r"|doing the arithmetic|does (the )?arithmetic)\b",
         "aphorism; a line written to be quoted rather than to inform",
         "give the number or the action the line stands for"),
    Rule(r"\b(isn('|\u2019)t|wasn('|\u2019)t|is not|was not|aren('|\u2019)t|weren('|\u2019)t|not)\b"
         r"[^.;\u2014]{0,70}\s[\u2014\u2013]\s*(it|they|it('|\u2019)s|that|this)\b",
         'two-beat reversal ("it wasn\'t X \u2014 it was Y"); the most recognisable LLM sentence shape',
         "say what it was; the reader did not assume X"),
    Rule(r"\bthe (one|single|only|real|main|key) (thing|design decision|decision|rule|lesson|detail|idea|trick)\b"
         r"[^.:]{0,60}:",
         "colon lead-in that promises a revelation",
         "start the sentence with the fact"),
    Rule(r"\bcaveat I('|\u2019)d want\b|\bhold me to\b|\bI('|\u2019)d want a reviewer\b",
         "performed humility",
         '"These scores are against LLM labels, not human ones."'),
    Rule(r"(?<!off-the-)(?<!off the )\bshelf\b(?!\s+life)",
         "marketplace-as-shelf metaphor; keep at most one, defined on first use",
         '"marketplace listing page"', "warn"),
)


@dataclass(frozen=True)
class RuleSet:
    banned: tuple[Rule, ...] = BANNED
    limits: Limits = field(default_factory=Limits)
    hyperparameter: str = HYPERPARAMETER
    headline_activity: str = HEADLINE_ACTIVITY
    version_prefix: str = VERSION_PREFIX

    def with_limits(self, **limits: int) -> RuleSet:
        return replace(self, limits=replace(self.limits, **limits))


DEFAULT_RULES = RuleSet()


def read_rules(spark: SparkSession, path: str) -> RuleSet:
    """Rules from one JSON file with `banned`, `structure` and the three patterns. A rule file is small
    configuration, read on the driver like any option."""
    schema = (
        "banned array<struct<re:string, why:string, instead:string, severity:string, caseSensitive:boolean>>, "
        "structure struct<maxSentenceWords:int, maxEmDashesPerBlock:int, maxParenAsidesPerBlock:int, "
        "minClosingSentenceWords:int, minSentencesForClosingCheck:int, maxHyperparametersPerSentence:int, "
        "maxFigureRepeats:int>, hyperparameter string, headlineActivity string, versionPrefix string"
    )
    row = spark.read.schema(schema).json(path, multiLine=True).first()
    banned = tuple(
        Rule(r["re"], r["why"], r["instead"], "warn" if r["severity"] == "warn" else "error", bool(r["caseSensitive"]))
        for r in row["banned"]
    )
    limits = Limits(*row["structure"])
    return RuleSet(banned, limits, row["hyperparameter"], row["headlineActivity"], row["versionPrefix"])
