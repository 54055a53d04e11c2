"""Word lists, patterns and thresholds that results depend on."""

# fixed values: stop words of title comparison
TITLE_STOP_WORDS = (
    "a an the and or but to of in on at for with from by as is are was were be been being this that these those "
    "after before during over under up down into out off near new latest live update updates watch video"
).split()
# fixed values: suffixes that the stemmer strips, in this order
SUFFIXES = ("ing", "ed", "es", "s")
# fixed values: tokens of contradicting titles
NEGATION = "no not never unclear undefined unknown denies deny without".split()
ASSERTIVE = "confirmed confirms confirm announces outlined outlines declares says".split()
# fixed values: stop words and keywords of story signatures
SIGNATURE_STOP_WORDS = (
    "the a an to for of in on and or with from after before amid over under about new news says say live latest "
    "update updates video breaking watch analysis report"
).split()
SIGNATURE_KEYWORDS = "government ministry agency court police military fifa olympics cup election".split()
# fixed values: tokens that do not speak for a merge on their own
GENERIC_TOKENS = ("world", "united states", "new york", "breaking", "news", "cup", "government", "election")
# fixed values: article typing, as case-insensitive patterns
URL_OPINION = ("/opinion/", "/editorial/", "/comment/", "/column/")
URL_ANALYSIS = ("/analysis/", "/explainer/", "/explain/", "/background/")
TITLE_OPINION = ("opinion", "editorial", "commentary", "column", r"our\s+view")
TITLE_ANALYSIS = ("analysis", "explainer", "explained", r"what\s+we\s+know", r"why\s+it\s+matters")
STANCE = (r"i\s+think", r"in\s+my\s+view", r"we\s+think", r"we\s+believe", r"our\s+view", r"i\s+argue", r"we\s+argue")
NORMATIVE = ("should", "must", r"need\s+to", r"have\s+to")
VALUE = ("outrageous", "disgraceful", "shameful", "absurd", "ridiculous")
INTERPRET = (
    r"what\s+it\s+means", r"why\s+it\s+matters", r"this\s+means", "signals?", "indicates?", "suggests?", "likely",
    "unlikely", r"could\s+lead\s+to", r"may\s+lead\s+to", "risk", "impact", "because", "therefore",
)
# fixed values: rules for Chinese source names
SOURCE_RULES_ZH = ((r"(?i)^al jazeera(\s|$)", "半岛电视台"), (r"(?i)^bbc\s+middle\s+east", "BBC中东"), (r"(?i)^bbc(\s|$)", "BBC新闻"))
