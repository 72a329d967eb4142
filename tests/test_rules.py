"""Every rule fires on a text made for it and not on its counterpart; matching is bounded by words."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgrid.functions.segment import Document, masked
from quillgrid.operators.detect import Detector, Settings
from quillgrid.plans import lexicons as L
from quillgrid.plans.rules import BY_ID, RULES, syllables

_detectors: dict[str, Detector] = {}


def fired(text: str, pack: str | None = None) -> list[str]:
    pack = pack or "microsoft"
    d = _detectors.setdefault(pack, Detector(Settings(pack)))
    return [f[0] for f in d.find(text)]


LISTS = {
    "marketing-buzzword": L.BUZZWORDS, "hype-intensifier": L.HYPE, "redundant-pair": L.PAIRS, "wordy-phrase": L.WORDY, "complex-word": L.COMPLEX, "nominalization": L.NOMINAL,
    "media-coverage-boilerplate": L.MEDIA, "future-outlook-speculation": L.OUTLOOK, "conversational-scaffolding": L.SCAFFOLDING, "use-contractions": L.CONTRACTIONS, "singular-they": L.PRONOUN_PAIRS,
    "minimizing-words": L.MINIMIZING, "latinism-abbreviation": L.LATINISMS, "american-spelling": L.BRITISH, "no-preannounce": L.PREANNOUNCE, "no-directional": L.DIRECTIONAL, "person-first-language": L.PERSON_FIRST,
    "ageist-classist-cultural": L.AGEIST, "redundant-acronym": L.REDUNDANT_ACRONYMS, "microsoft-accessibility": L.ACCESSIBILITY, "microsoft-contractions": L.IS_CONTRACTIONS, "ms-term-swaps": L.MS_TERMS,
    "ms-wordiness": L.MS_WORDINESS, "google-contractions": L.IS_CONTRACTIONS, "google-word-list": L.GOOGLE_WORDS, "ap-toward": L.AP_TOWARD, "chicago-directional-s": L.CHICAGO_TOWARD, "chicago-ibid": L.IBID,
    "plain-hidden-verb": L.HIDDEN_VERBS, "plain-required-to": L.REQUIRED_TO, "plain-legalese-phrase": L.LEGALESE_PHRASES, "plain-legalese-word": L.LEGALESE, "ableist-language": [*L.ABLEIST_WARN, *L.ABLEIST_ADVISORY],
    "violent-tech-metaphor": L.VIOLENT, "tech-historical-terms": L.HISTORICAL,
}


@pytest.mark.parametrize("rule", LISTS)
def test_lists(rule):
    pack = BY_ID[rule].pack
    for phrase in LISTS[rule]:
        assert rule in fired(f"So {phrase} it went.", pack), phrase
        assert rule not in fired(f"So qx{phrase.replace(' ', 'q').replace('-', 'q').replace('.', 'q').replace('/', 'q').replace('(', 'q').replace(')', 'q')}xq it went.", pack), phrase


NUMBERED = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
CASES = [
    ("overused-word", None, "They delve with a robust tool.", "They dig with a robust tool."),
    ("cliche-opener", None, "When it comes to rain, carry a coat.", "Carry a coat when it comes to rain."),
    ("filler-phrase", None, "Needless to say, it rained.", "It rained."),
    ("manufactured-contrast", None, "It is not just a tool but a way.", "It is a tool."),
    ("conclusion-restate", None, "Text.\n\nIn summary, it rained.", "The rain, in summary, fell."),
    ("vague-attribution", None, "Some say it rains.", "Some say it rains, see [1](x)."),
    ("despite-challenges-closer", None, "Despite its challenges, the town continues to thrive.", "The town grew."),
    ("significance-boilerplate", None, "It plays a key role here.", "It matters here."),
    ("em-dash-overuse", None, "One — two — three — four.", "One — two."),
    ("emoji-decoration", None, "- ✅ Done it.", "Done ✅ it."),
    ("bold-lead-in-list", None, "- **A**: x\n- **B**: y\n- **C**: z", "- **A**: x\n- **B**: y"),
    ("assistant-meta", None, "Feel free to ask.", "Please ask."),
    ("sycophancy", None, "Great question, thanks.", "Thanks."),
    ("smart-quotes", None, "“a” and ‘b’", "\"a\" and 'b'"),
    ("unicode-artifact", None, "A​word.", "A word."),
    ("hedge-overuse", None, "It is arguably somewhat late and sort of new.", "It is arguably late."),
    ("passive-voice", None, "The door was opened by him.", "The door is open."),
    ("long-sentence", None, " ".join(NUMBERED * 2) + ".", " ".join(NUMBERED) + "."),
    ("weasel-word", None, "It is very quite really late.", "It is very late."),
    ("repeated-word", None, "It was was late.", "He knew that that was late."),
    ("there-is-expletive", None, "There are some men who wait.", "See, there are some men who wait."),
    ("sentence-case-heading", None, "# Some Very Long Title", "# Some very long title"),
    ("heading-end-punctuation", None, "# A title.", "# A title"),
    ("word-swap", None, "We execute it.", "We run it."),
    ("gendered-language", None, "A businessman came.", "A person came."),
    ("vague-link-text", None, "Look [here](a.md).", "Look [at the guide](a.md)."),
    ("skipped-heading", None, "# A\n\n### B", "### A\n\n#### B"),
    ("negative-parallelism", None, "It is big, not small. It is red, not blue.", "It is big, not small."),
    ("tricolon-overuse", None, "a, b, and c. d, e, and f. g, h, and i.", "a, b, and c."),
    ("serves-as-copula", None, "It serves as a door and acts as a wall.", "It serves as a door."),
    ("superficial-ing-participle", None, "It rose, reflecting hope, ensuring peace.", "It rose, reflecting hope."),
    ("transition-scaffolding", None, "Moreover, a.\n\nHowever, b.", "Moreover, a."),
    ("interrogative-answer", None, "The result? Rain.", "What rain?"),
    ("excessive-bold", None, "**a** **b** **c** **d**", "**a** b"),
    ("listicle-reflex", None, "- a\n- b\n- c\n- d\n- e", "- a\n- b"),
    ("uniform-cadence", None, "A b c d e. " * 6, "A b c d e. " * 3),
    ("emphasis-as-heading", None, "**A bold title**", "**A label:**"),
    ("bare-url", None, "See https://a.org/x now.", "See [a](https://a.org/x) now."),
    ("fenced-code-language", None, "```\nx\n```", "```py\nx\n```"),
    ("duplicate-heading", None, "# A\n\n## B\n\n## b", "# A\n\n## B"),
    ("acronym-case", None, "Use SQL. The sql is old.", "Use SQL."),
    ("acronym-plural", None, "Two UDF's ran.", "Two UDFs ran."),
    ("inconsistent-capitalization", None, "See Blue Door there. A blue door is here.", "See Blue Door there."),
    ("adverb-overuse", None, "Slowly badly sadly madly gladly he ran.", "Slowly he ran."),
    ("undefined-acronym", None, "The QZX ran.", "The quick zone (QZX) ran."),
    ("reading-grade", "plain", "Institutional organizational responsibilities " * 12 + ".", "He ran on. " * 12),
    ("serial-comma", None, "He has red, blue and green ones.", "He has red, blue, and green ones."),
    ("second-person", None, "The user must wait.", "You must wait."),
    ("present-tense", None, "Then you will see it.", "Then you see it."),
    ("no-please-instructions", None, "Please wait.", "Wait."),
    ("terminology-consistency", None, "A filename is a file name.", "A filename is short."),
    ("no-space-em-dash", None, "One — two.", "One—two."),
    ("no-internal-caps", None, "A fooBar here.", "An iPhone here."),
    ("omit-you-can", None, "Here you can wait.", "Wait."),
    ("avoid-we", None, "We ran and our dog saw us.", "We ran."),
    ("spell-out-small-numbers", None, "He has 3 dogs.", "He has 13 dogs."),
    ("no-numeral-sentence-start", None, "12 dogs ran.", "He has 12 dogs."),
    ("large-number-grouping", None, "He has 12345 dogs.", "He has 1234 dogs."),
    ("no-k-m-b", None, "He has 5K dogs.", "He has five dogs."),
    ("leading-zero", None, "It is .5 long.", "It is 0.5 long."),
    ("no-gerund-heading", "google", "# Running dogs", "# Run dogs"),
    ("no-link-in-heading", "google", "# See [a](b.md)", "# See a"),
    ("no-abbreviation-as-verb", "google", "Then ssh into it.", "Then use ssh to enter."),
    ("no-periods-in-acronyms", "google", "The U.S.A. won.", "It is so, e.g. now."),
    ("no-exclamation", "google", "He ran!", "He != it."),
    ("ap-serial-comma", "ap", "red, blue, and green", "red, blue and green"),
    ("ap-number-style", "ap", "He has 3 dogs.", "He has 13 dogs."),
    ("chicago-number-style", "chicago", "He has 99 dogs.", "He has 101 dogs."),
    ("plain-long-sentence", "plain", " ".join(NUMBERED) + " more.", "One two."),
    ("gendered-address", None, "Hey guys.", "Hey all."),
    ("missing-alt-text", None, "![](a.png)", "![A door](a.png)"),
    ("all-caps-shouting", None, "DO NOT RUN here.", "DO NOT run."),
    ("markup-leak", None, "#Title", "# Title"),
    ("thematic-break-before-heading", None, "a\n\n---\n\n## B", "a\n\n---\n\nb"),
    ("bullet-overuse", None, "- aa bb cc dd ee\n" * 8, "- a\n" * 3),
    ("double-space", None, "a  b", "a.  b"),
    ("indefinite-article", None, "He saw a apple.", "He saw a user and an hour."),
    ("placeholder-citation", None, "So [TODO] it.", "So it."),
    ("tracking-param-in-citation", None, "https://a.org/?utm_source=x", "https://a.org/?x=1"),
    ("malformed-doi-isbn", None, "doi: 11.1/x", "doi: 10.1234/x"),
    ("unused-named-ref", None, "Text.\n\n[a]: https://x.org", "See [t][a].\n\n[a]: https://x.org"),
    ("microsoft-ampm", None, "At 9AM now.", "At 9 amps now."),
    ("microsoft-adverbs", None, "He badly and sadly ran.", "He badly ran."),
    ("microsoft-auto-hyphenation", None, "An auto-save.", "An autosave."),
    ("microsoft-avoid-words", None, "The backend ran.", "The server ran."),
    ("ms-date-format", None, "On 31 July 2016 it ran.", "On July 31, 2016 it ran."),
    ("ms-date-numbers", None, "On July first it ran.", "On July 1 it ran."),
    ("ms-date-order", None, "On 7/31/2016 it ran.", "On July 31 it ran."),
    ("ms-ellipses", None, "Well... so.", "Well. So."),
    ("ms-first-person", None, "I saw my dog.", "I saw a dog."),
    ("ms-foreign-abbrev", None, "One, e.g. this.", "One, IE here."),
    ("ms-gender-slash", None, "If he/she runs.", "If they run."),
    ("ms-gender-bias", None, "A fireman ran.", "A human ran."),
    ("microsoft-general-url", None, "The URL here.", "The address here."),
    ("microsoft-heading-acronyms", None, "# The API here", "# The tool here"),
    ("microsoft-heading-colons", None, "# Tool: a door", "# Tool: A door"),
    ("ms-adverb-hyphen", None, "A newly-made door.", "A family-owned door."),
    ("ms-negative-number-endash", None, "It is -5 now.", "It is 5 now."),
    ("ms-ordinal-ly", None, "Firstly, run.", "First, run."),
    ("ms-percentages", None, "Some ten percent.", "Some 10 percent."),
    ("ms-plurals-parenthetical", None, "The dog(s) ran.", "The dogs ran."),
    ("microsoft-quotes-punctuation", None, "A “door”, so.", "A “door,” so."),
    ("microsoft-range-time", None, "9 AM - 10 PM now.", "9 AM to 10 PM now."),
    ("microsoft-semicolon", None, "He ran; so.", "A&nbsp;b."),
    ("ms-suspended-hyphen", None, "The pre- and post-war.", "The war."),
    ("ms-url-of", None, "The url for it.", "The URL of it."),
    ("ms-units-spelled-number", None, "Some ten miles.", "Some 10 miles."),
    ("ms-vocab-az-wordlist", None, "Allow the alarm.", "Allow it."),
    ("google-ampm", "google", "At 9 am now.", "At 9 AM now."),
    ("google-date-format", "google", "On 31 July 2016 so.", "On July 31, 2016 so."),
    ("google-ellipses", "google", "Well... so.", "Well. So."),
    ("google-dash-spacing", "google", "One – two.", "One–two."),
    ("google-first-person", "google", "I saw my dog.", "I saw it."),
    ("google-gender-neutral-pronoun", "google", "If s/he runs.", "If they run."),
    ("google-gender-bias", "google", "A waitress ran.", "A server ran."),
    ("google-ly-hyphen", "google", "A newly-made door.", "An early-stage door."),
    ("google-optional-plurals", "google", "The dog(s) ran.", "The dogs ran."),
    ("google-ordinal", "google", "The 3rd dog.", "The third dog."),
    ("google-quote-punctuation", "google", 'A "door", so.', 'A "door," so.'),
    ("google-number-range-words", "google", "From 5-10 dogs.", "5-10 dogs."),
    ("google-semicolons", "google", "He ran; so.", "He ran."),
    ("google-slang", "google", "So, imo, run.", "So run."),
    ("google-units-nbsp", "google", "Some 10MB here.", "Some 10 MB here."),
    ("avoid-first-person-plural", "google", "We saw our dog.", "We saw it."),
    ("avoid-will-future-tense", "google", "It will run and will stop.", "It will run."),
    ("ap-percent", "ap", "Some 5% here.", "Some 5 percent here."),
    ("ap-time-format", "ap", "At 9 AM now.", "At 9 a.m. now."),
    ("ap-dollar-style", "ap", "Some 5 million dollars.", "Some $5 million."),
    ("ap-over-quantity", "ap", "It is over 5 so.", "It is over there."),
    ("ap-ampersand", "ap", "Dogs & cats.", "Dogs and cats."),
    ("chicago-percent-symbol", "chicago", "Some 5% here.", "Some 5 percent."),
    ("chicago-em-dash-spacing", "chicago", "One — two.", "One—two."),
    ("chicago-ellipsis", "chicago", "Well… so.", "Well. So."),
    ("chicago-united-states-noun", "chicago", "Then the US is big.", "Then the US army won."),
    ("plain-shall", "plain", "He shall run.", "He must run."),
    ("plain-double-negative", "plain", "It is not unclear.", "It is clear."),
]


@pytest.mark.parametrize(("rule", "pack", "bad", "good"), CASES, ids=[c[0] for c in CASES])
def test_pairs(rule, pack, bad, good):
    assert rule in fired(bad, pack)
    assert rule not in fired(good, pack)


def test_every_rule_is_covered():
    assert len(RULES) == 171 == len(BY_ID)
    assert set(BY_ID) == {c[0] for c in CASES} | set(LISTS)


def test_packs_gate_rules():
    count = {p: sum(r.pack in (None, p) for r in RULES) for p in ("microsoft", "google", "ap", "chicago", "plain")}
    assert count == {"microsoft": 119, "google": 108, "ap": 87, "chicago": 86, "plain": 87}


def test_masking_hides_code_and_keeps_places():
    text = "---\ntitle: the the\n---\nA `the the` and\n```\nthe the\n```\n<!-- the the --> {{ the the }} <b the the>\nthe the"
    shown = masked(text)
    assert len(shown) == len(text) and [k for k, c in enumerate(text) if c == "\n"] == [k for k, c in enumerate(shown) if c == "\n"]
    assert shown.count("the the") == 1
    (f,) = [f for f in Detector(Settings(only=frozenset(["repeated-word"]))).find(text)]
    assert text[f[5] : f[5] + f[6]] == "the the" and f[3] == text.count("\n") + 1


def test_ignores():
    assert Detector(Settings(ignore_rules=frozenset(["repeated-word"]))).find("It was was late.") == []
    assert Detector(Settings(ignore_values=(("repeated-word", ("WAS",)),), only=frozenset(["repeated-word"]))).find("It was was, it it.")[0][7] == "it it"


def test_other_scripts_are_left_alone():
    assert fired("это " * 60 + "the the") == []


def test_syllables():
    assert [syllables(w) for w in ("table", "made", "idea", "running", "yes")] == [3, 1, 3, 2, 1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aA the.!?\n`#*-[]()<>{}|~1\réあ", max_size=200))
def test_findings_lie_in_the_text(text):
    for pack in ("microsoft", "google", "plain"):
        d = _detectors.setdefault(pack, Detector(Settings(pack)))
        found = d.find(text)
        assert len({(f[0], f[5]) for f in found}) == len(found)
        for f in found:
            assert 0 <= f[5] <= len(text) and f[3] == text.count("\n", 0, f[5]) + 1
    doc = Document(text)
    ends = [0]
    for s in doc.sentences:
        assert ends[-1] <= s.start <= s.end <= len(text)
        ends.append(s.end)
