"""These must equal the published contract for right results."""

SPEC_VERSION = "1.1.9"

START_MARKER = "*** START OF THE PROJECT GUTENBERG EBOOK"
END_MARKER = "*** END OF THE PROJECT GUTENBERG EBOOK"

#: Header fields that are recognised at column 0, in any case.
FIELDS = ("Title", "Author", "Editor", "Illustrator", "Translator", "Release date", "Language", "Credits")

#: English stop words, exact matches.
STOP_WORDS = tuple("""
a about above after again against all am an and any are aren't as at be because been before being below
between both but by can can't cannot could couldn't did didn't do does doesn't doing don't down during each
few for from further had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers
herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more
most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same
shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves
then there there's these they they'd they'll they're they've this those through to too under until up very
was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's
whom why why's with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split())

#: Language names and their ISO 639-1 codes.
LANGUAGES = {
    "english": "en", "italian": "it", "french": "fr", "german": "de", "spanish": "es", "portuguese": "pt",
    "dutch": "nl", "danish": "da", "swedish": "sv", "norwegian": "no", "finnish": "fi", "icelandic": "is",
    "polish": "pl", "czech": "cs", "hungarian": "hu", "romanian": "ro", "russian": "ru", "greek": "el",
    "latin": "la", "chinese": "zh", "japanese": "ja", "arabic": "ar", "hebrew": "he",
}

#: White space that strips and collapses count (the code points for which Python's str.isspace is true).
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
