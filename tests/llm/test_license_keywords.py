"""The licence rules' prefilters let every alternative of every pattern through."""

import itertools
import re
import re._parser as parser

from fathomline.llm import licenses
from fathomline.llm.license_rules import STEMS, signature_rules


def alternatives(parsed):
    """A match for every way through a pattern: each branch, each optional part with and without, one of each class."""
    ways = []
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            ways.append([chr(value)])
        elif name == "IN":
            ways.append([chr(v if str(o) == "LITERAL" else v[0]) for o, v in value])
        elif name == "ANY":
            ways.append(["x"])
        elif name == "BRANCH":
            ways.append([w for branch in value[1] for w in alternatives(branch)])
        elif name == "SUBPATTERN":
            ways.append(list(alternatives(value[3])))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = value
            inner = list(alternatives(inner))
            ways.append([w * n for n in {low, min(high, low + 1)} for w in inner])
        else:
            raise ValueError(name)
    return ("".join(p) for p in itertools.product(*(list(dict.fromkeys(w)) for w in ways)))


def test_every_alternative_passes_gate_and_keyword():
    for rule in signature_rules():
        for match in alternatives(parser.parse(rule.pattern.replace("[cs]", "c"))):
            assert any(k in match for k in rule.keyword.split("|")), (rule, match)
            assert any(s in match for s in STEMS) or re.search(r"\bcc(?:0| )", match), (rule, match)


def test_phrases_of_single_alternatives(spark):
    want = {
        "GNU Public License": "gpl", "Expat License": "mit", "the simplified license": "bsd-2", "PNG reference library license": "libpng",
        "RAIL license": "openrail", "BigScience BLOOM RAIL license": "openrail", "CreativeML OpenRAIL-M license": "openrail",
        "Redistributions and use in source and binary forms, with or without modification": "bsd", "MIT license, Expat license": "mit",
    }
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == list(want.values())
    assert all(r.score > 0 for r in rows)
