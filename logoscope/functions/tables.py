"""What a character is called, which scripts there are, which marks are read aloud."""

from __future__ import annotations

#: Fixed: keyword in a character's Unicode name, script; the first keyword found counts.
SCRIPT_KEYWORDS = {
    "CYRILLIC": "CYRILLIC", "ARABIC": "ARABIC", "HEBREW": "HEBREW", "GREEK": "GREEK", "DEVANAGARI": "DEVANAGARI",
    "BENGALI": "BENGALI", "GURMUKHI": "GURMUKHI", "GUJARATI": "GUJARATI", "TAMIL": "TAMIL", "TELUGU": "TELUGU",
    "KANNADA": "KANNADA", "MALAYALAM": "MALAYALAM", "THAI": "THAI", "LAO": "LAO", "TIBETAN": "TIBETAN",
    "MYANMAR": "MYANMAR", "GEORGIAN": "GEORGIAN", "HANGUL": "HANGUL", "ETHIOPIC": "ETHIOPIC", "KHMER": "KHMER",
    "SINHALA": "SINHALA", "ARMENIAN": "ARMENIAN", "HIRAGANA": "CJK", "KATAKANA": "CJK", "CJK": "CJK",
}

#: Fixed: language of a script by default; the last two are sentinels without a voice.
SCRIPT_LANGUAGES = {
    "CYRILLIC": "ru", "ARABIC": "ar", "HEBREW": "he", "GREEK": "el", "DEVANAGARI": "hi", "BENGALI": "bn", "THAI": "th",
    "GEORGIAN": "ka", "ARMENIAN": "hy", "HANGUL": "ko", "CJK": "zh", "IPA": "ipa", "BRAILLE": "unicode_braille",
}
SENTINELS = ("ipa", "unicode_braille")

#: Fixed: spoken names of characters by Unicode name, in order of code points.
SPOKEN_NAMES = {
    "INVERTED EXCLAMATION MARK": "inverted exclamation mark", "CENT SIGN": "cent", "POUND SIGN": "pound",
    "CURRENCY SIGN": "currency", "YEN SIGN": "yen", "BROKEN BAR": "broken bar", "SECTION SIGN": "section sign",
    "COPYRIGHT SIGN": "copyright", "NOT SIGN": "not sign", "SOFT HYPHEN": "soft hyphen", "REGISTERED SIGN": "registered",
    "DEGREE SIGN": "degree", "PLUS-MINUS SIGN": "plus minus", "SUPERSCRIPT TWO": "superscript 2",
    "SUPERSCRIPT THREE": "superscript 3", "MICRO SIGN": "micro", "PILCROW SIGN": "pilcrow", "MIDDLE DOT": "middle dot",
    "SUPERSCRIPT ONE": "superscript 1", "VULGAR FRACTION ONE QUARTER": "one quarter", "VULGAR FRACTION ONE HALF": "one half",
    "VULGAR FRACTION THREE QUARTERS": "three quarters", "INVERTED QUESTION MARK": "inverted question mark",
    "MULTIPLICATION SIGN": "times", "DIVISION SIGN": "divided by", "LATIN SMALL LETTER ENG": "eng",
    "LATIN SMALL LETTER TURNED A": "turned a", "LATIN SMALL LETTER ALPHA": "alpha",
    "LATIN SMALL LETTER TURNED ALPHA": "turned alpha", "LATIN SMALL LETTER B WITH HOOK": "b hook",
    "LATIN SMALL LETTER OPEN O": "open o", "LATIN SMALL LETTER C WITH CURL": "c curl",
    "LATIN SMALL LETTER D WITH TAIL": "d tail", "LATIN SMALL LETTER D WITH HOOK": "d hook",
    "LATIN SMALL LETTER SCHWA": "schwa", "LATIN SMALL LETTER OPEN E": "open e",
    "LATIN SMALL LETTER REVERSED OPEN E": "reversed open e", "LATIN SMALL LETTER DOTLESS J WITH STROKE": "barred dotless j",
    "LATIN SMALL LETTER G WITH HOOK": "g hook", "LATIN LETTER SMALL CAPITAL G": "small capital g",
    "LATIN SMALL LETTER GAMMA": "gamma", "LATIN SMALL LETTER RAMS HORN": "rams horn",
    "LATIN SMALL LETTER TURNED H": "turned h", "LATIN SMALL LETTER H WITH HOOK": "h hook",
    "LATIN LETTER SMALL CAPITAL I": "small capital i", "LATIN SMALL LETTER LEZH": "lezh",
    "LATIN SMALL LETTER TURNED M": "turned m", "LATIN SMALL LETTER TURNED M WITH LONG LEG": "turned m long leg",
    "LATIN SMALL LETTER N WITH LEFT HOOK": "n left hook", "LATIN SMALL LETTER N WITH RETROFLEX HOOK": "n retroflex hook",
    "LATIN LETTER SMALL CAPITAL N": "small capital n", "LATIN LETTER SMALL CAPITAL OE": "small capital o e",
    "LATIN SMALL LETTER PHI": "phi", "LATIN SMALL LETTER TURNED R": "turned r",
    "LATIN SMALL LETTER TURNED R WITH HOOK": "turned r hook", "LATIN SMALL LETTER R WITH FISHHOOK": "r fishhook",
    "LATIN LETTER SMALL CAPITAL R": "small capital r", "LATIN SMALL LETTER S WITH HOOK": "s hook",
    "LATIN SMALL LETTER ESH": "esh", "LATIN SMALL LETTER SQUAT REVERSED ESH": "squat reversed esh",
    "LATIN SMALL LETTER T WITH RETROFLEX HOOK": "t retroflex", "LATIN SMALL LETTER UPSILON": "upsilon",
    "LATIN SMALL LETTER V WITH HOOK": "v hook", "LATIN SMALL LETTER TURNED V": "turned v",
    "LATIN SMALL LETTER TURNED W": "turned w", "LATIN SMALL LETTER TURNED Y": "turned y",
    "LATIN SMALL LETTER Z WITH RETROFLEX HOOK": "z retroflex", "LATIN SMALL LETTER Z WITH CURL": "z curl",
    "LATIN SMALL LETTER EZH": "ezh", "LATIN LETTER GLOTTAL STOP": "glottal stop",
    "LATIN LETTER PHARYNGEAL VOICED FRICATIVE": "pharyngeal fricative",
    "LATIN LETTER INVERTED GLOTTAL STOP": "inverted glottal stop", "LATIN LETTER STRETCHED C": "stretched c",
    "LATIN LETTER SMALL CAPITAL L": "small capital l", "MODIFIER LETTER SMALL H": "aspirated",
    "MODIFIER LETTER SMALL J": "palatalized", "MODIFIER LETTER SMALL W": "labialized",
    "MODIFIER LETTER VERTICAL LINE": "primary stress", "MODIFIER LETTER LOW VERTICAL LINE": "secondary stress",
    "MODIFIER LETTER TRIANGULAR COLON": "long", "MODIFIER LETTER HALF TRIANGULAR COLON": "half long",
    "MODIFIER LETTER RHOTIC HOOK": "rhoticity", "MODIFIER LETTER SMALL GAMMA": "velarized",
    "ZERO WIDTH SPACE": "zero width space", "ZERO WIDTH NON-JOINER": "zero width non-joiner",
    "ZERO WIDTH JOINER": "zero width joiner", "LEFT-TO-RIGHT MARK": "left to right mark",
    "RIGHT-TO-LEFT MARK": "right to left mark", "HYPHEN": "hyphen", "NON-BREAKING HYPHEN": "non-breaking hyphen",
    "FIGURE DASH": "figure dash", "HORIZONTAL BAR": "horizontal bar", "BULLET": "bullet",
    "TRIANGULAR BULLET": "triangular bullet", "HORIZONTAL ELLIPSIS": "ellipsis", "HYPHENATION POINT": "hyphenation point",
    "INTERROBANG": "interrobang", "WORD JOINER": "word joiner", "SUPERSCRIPT ZERO": "superscript 0",
    "SUBSCRIPT ZERO": "subscript 0", "SUBSCRIPT ONE": "subscript 1", "SUBSCRIPT TWO": "subscript 2",
    "SUBSCRIPT THREE": "subscript 3", "SUBSCRIPT FOUR": "subscript 4", "SUBSCRIPT FIVE": "subscript 5",
    "SUBSCRIPT SIX": "subscript 6", "SUBSCRIPT SEVEN": "subscript 7", "SUBSCRIPT EIGHT": "subscript 8",
    "SUBSCRIPT NINE": "subscript 9", "EURO SIGN": "euro", "INDIAN RUPEE SIGN": "rupee", "TURKISH LIRA SIGN": "lira",
    "RUBLE SIGN": "ruble", "BITCOIN SIGN": "bitcoin", "DEGREE CELSIUS": "degrees celsius",
    "DEGREE FAHRENHEIT": "degrees fahrenheit", "NUMERO SIGN": "numero", "TRADE MARK SIGN": "trademark",
    "VULGAR FRACTION ONE THIRD": "one third", "VULGAR FRACTION TWO THIRDS": "two thirds",
    "VULGAR FRACTION ONE FIFTH": "one fifth", "VULGAR FRACTION TWO FIFTHS": "two fifths",
    "VULGAR FRACTION THREE FIFTHS": "three fifths", "VULGAR FRACTION FOUR FIFTHS": "four fifths",
    "VULGAR FRACTION ONE SIXTH": "one sixth", "VULGAR FRACTION FIVE SIXTHS": "five sixths",
    "VULGAR FRACTION ONE EIGHTH": "one eighth", "VULGAR FRACTION THREE EIGHTHS": "three eighths",
    "VULGAR FRACTION FIVE EIGHTHS": "five eighths", "VULGAR FRACTION SEVEN EIGHTHS": "seven eighths",
    "LEFTWARDS ARROW": "left arrow", "UPWARDS ARROW": "up arrow", "RIGHTWARDS ARROW": "right arrow",
    "DOWNWARDS ARROW": "down arrow", "LEFT RIGHT ARROW": "left right arrow", "UP DOWN ARROW": "up down arrow",
    "NORTH WEST ARROW": "northwest arrow", "NORTH EAST ARROW": "northeast arrow", "SOUTH EAST ARROW": "southeast arrow",
    "SOUTH WEST ARROW": "southwest arrow", "LEFTWARDS DOUBLE ARROW": "left double arrow",
    "UPWARDS DOUBLE ARROW": "up double arrow", "RIGHTWARDS DOUBLE ARROW": "right double arrow",
    "DOWNWARDS DOUBLE ARROW": "down double arrow", "LEFT RIGHT DOUBLE ARROW": "left right double arrow", "FOR ALL": "for all",
    "PARTIAL DIFFERENTIAL": "partial differential", "THERE EXISTS": "there exists", "EMPTY SET": "empty set",
    "NABLA": "nabla", "ELEMENT OF": "element of", "NOT AN ELEMENT OF": "not element of", "N-ARY PRODUCT": "product",
    "MINUS SIGN": "minus", "BULLET OPERATOR": "bullet", "SQUARE ROOT": "square root", "PROPORTIONAL TO": "proportional to",
    "INFINITY": "infinity", "LOGICAL AND": "logical and", "LOGICAL OR": "logical or", "INTERSECTION": "intersection",
    "UNION": "union", "INTEGRAL": "integral", "TILDE OPERATOR": "tilde", "ALMOST EQUAL TO": "approximately equal",
    "NOT EQUAL TO": "not equal", "IDENTICAL TO": "identical to", "LESS-THAN OR EQUAL TO": "less than or equal",
    "GREATER-THAN OR EQUAL TO": "greater than or equal", "SUBSET OF": "subset of", "SUPERSET OF": "superset of",
    "STAR OPERATOR": "star", "BLACK SQUARE": "black square", "WHITE SQUARE": "white square",
    "BLACK UP-POINTING TRIANGLE": "up triangle", "BLACK RIGHT-POINTING TRIANGLE": "right triangle",
    "BLACK DOWN-POINTING TRIANGLE": "down triangle", "BLACK LEFT-POINTING TRIANGLE": "left triangle", "LOZENGE": "lozenge",
    "WHITE CIRCLE": "white circle", "BLACK CIRCLE": "black circle", "WHITE MEDIUM SQUARE": "white square",
    "BLACK MEDIUM SQUARE": "black square", "BLACK SUN WITH RAYS": "sun", "CLOUD": "cloud", "UMBRELLA": "umbrella",
    "SNOWMAN": "snowman", "COMET": "comet", "BLACK STAR": "black star", "WHITE STAR": "white star",
    "BALLOT BOX": "ballot box", "BALLOT BOX WITH CHECK": "checked ballot box", "BALLOT BOX WITH X": "x ballot box",
    "SKULL AND CROSSBONES": "skull and crossbones", "RADIOACTIVE SIGN": "radioactive", "BIOHAZARD SIGN": "biohazard",
    "PEACE SYMBOL": "peace", "YIN YANG": "yin yang", "BLACK SPADE SUIT": "spade", "WHITE HEART SUIT": "white heart",
    "WHITE DIAMOND SUIT": "white diamond", "BLACK CLUB SUIT": "club", "WHITE SPADE SUIT": "white spade",
    "BLACK HEART SUIT": "heart", "BLACK DIAMOND SUIT": "diamond", "WHITE CLUB SUIT": "white club",
    "HOT SPRINGS": "hot springs", "QUARTER NOTE": "quarter note", "EIGHTH NOTE": "eighth note",
    "BEAMED EIGHTH NOTES": "beamed eighth notes", "MUSIC FLAT SIGN": "flat", "MUSIC NATURAL SIGN": "natural",
    "MUSIC SHARP SIGN": "sharp", "ANCHOR": "anchor", "WARNING SIGN": "warning", "HIGH VOLTAGE SIGN": "high voltage",
    "CHECK MARK": "check mark", "HEAVY CHECK MARK": "check mark", "BALLOT X": "x mark", "HEAVY BALLOT X": "x mark",
    "SPARKLES": "sparkles", "SNOWFLAKE": "snowflake", "HEAVY LOW DOUBLE COMMA QUOTATION MARK ORNAMENT": "low double quote",
    "CURVED STEM PARAGRAPH SIGN ORNAMENT": "paragraph sign", "HEAVY EXCLAMATION MARK ORNAMENT": "exclamation mark",
    "HEAVY HEART EXCLAMATION MARK ORNAMENT": "heart exclamation", "HEAVY BLACK HEART": "red heart",
    "MEDIUM LEFT PARENTHESIS ORNAMENT": "left parenthesis", "MEDIUM RIGHT PARENTHESIS ORNAMENT": "right parenthesis",
    "MEDIUM FLATTENED LEFT PARENTHESIS ORNAMENT": "left parenthesis",
    "MEDIUM FLATTENED RIGHT PARENTHESIS ORNAMENT": "right parenthesis",
    "MEDIUM LEFT-POINTING ANGLE BRACKET ORNAMENT": "left angle bracket",
    "MEDIUM RIGHT-POINTING ANGLE BRACKET ORNAMENT": "right angle bracket",
    "HEAVY LEFT-POINTING ANGLE QUOTATION MARK ORNAMENT": "left angle quote",
    "HEAVY RIGHT-POINTING ANGLE QUOTATION MARK ORNAMENT": "right angle quote",
    "HEAVY LEFT-POINTING ANGLE BRACKET ORNAMENT": "left angle bracket",
    "HEAVY RIGHT-POINTING ANGLE BRACKET ORNAMENT": "right angle bracket",
    "LIGHT LEFT TORTOISE SHELL BRACKET ORNAMENT": "left bracket",
    "LIGHT RIGHT TORTOISE SHELL BRACKET ORNAMENT": "right bracket",
    "MEDIUM LEFT CURLY BRACKET ORNAMENT": "left curly bracket", "MEDIUM RIGHT CURLY BRACKET ORNAMENT": "right curly bracket",
    "DINGBAT NEGATIVE CIRCLED DIGIT ONE": "circled 1", "DINGBAT NEGATIVE CIRCLED DIGIT TWO": "circled 2",
    "DINGBAT NEGATIVE CIRCLED DIGIT THREE": "circled 3", "DINGBAT NEGATIVE CIRCLED DIGIT FOUR": "circled 4",
    "DINGBAT NEGATIVE CIRCLED DIGIT FIVE": "circled 5", "DINGBAT NEGATIVE CIRCLED DIGIT SIX": "circled 6",
    "DINGBAT NEGATIVE CIRCLED DIGIT SEVEN": "circled 7", "DINGBAT NEGATIVE CIRCLED DIGIT EIGHT": "circled 8",
    "DINGBAT NEGATIVE CIRCLED DIGIT NINE": "circled 9", "DINGBAT NEGATIVE CIRCLED NUMBER TEN": "circled 10",
    "REVERSED QUESTION MARK": "reversed question mark", "LATIN SMALL LETTER BETA": "beta",
    "OBJECT REPLACEMENT CHARACTER": "object replacement", "REPLACEMENT CHARACTER": "replacement character",
}

#: Fixed: prefixes of Unicode names that aren't spoken (the first that fits), and words left out in brief mode.
NAME_PREFIXES = (
    "BOX DRAWINGS ", "BLOCK ", "BRAILLE PATTERN ", "DINGBAT ", "MODIFIER LETTER SMALL ", "MODIFIER LETTER ",
    "LATIN SMALL LETTER ", "LATIN CAPITAL LETTER ", "LATIN LETTER SMALL CAPITAL ", "LATIN LETTER ",
)
BRIEF_WORDS = ("HEAVY", "MEDIUM", "LIGHT", "ORNAMENT", "NEGATIVE")

#: Fixed: code point ranges that speech engines read by themselves, beyond letters and decimal digits.
READ_ALOUD = (
    (0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA0, 0xA0), (0xAB, 0xAB), (0xBB, 0xBB), (0xC0, 0x24F), (0x2013, 0x2014),
    (0x2018, 0x201A), (0x201C, 0x201E), (0x2026, 0x2026), (0x2039, 0x203A),
)
#: Fixed: phonetic ranges that they don't read, letters or not.
PHONETIC = ((0x250, 0x2FF), (0x1D00, 0x1DBF))
#: Fixed: invisible characters besides those of category Cf.
INVISIBLE = ((0x034F, 0x034F), (0x2028, 0x2029), (0xFE00, 0xFE0F), (0x1F1E6, 0x1F1FF), (0xE0100, 0xE01EF))

#: Fixed: emoticons and what is said for them.
EMOTICONS = {
    ":-)": "smiley face", ":)": "smiley face", ":-(": "sad face", ":(": "sad face", ":-D": "grinning face",
    ":D": "grinning face", ":-d": "grinning face", ":d": "grinning face", ";-)": "winking face", ";)": "winking face",
    ":-P": "tongue out", ":P": "tongue out", ":-p": "tongue out", ":p": "tongue out", ":-/": "confused face",
    ":/": "confused face", ":-\\": "confused face", ":\\": "confused face", ":-O": "surprised face", ":O": "surprised face",
    ":-o": "surprised face", ":o": "surprised face", ":-|": "neutral face", ":|": "neutral face", ":-*": "kiss", ":*": "kiss",
    ":'(": "crying face", ":'-(": "crying face", ">:(": "angry face", ">:-(": "angry face", "<3": "heart",
    "</3": "broken heart", "XD": "laughing", "xD": "laughing", "T_T": "crying", "T.T": "crying", "O_O": "shocked",
    "o_o": "shocked", "O.O": "shocked", "^_^": "happy", "^-^": "happy", "^^": "happy", ">_<": "frustrated",
    ">.<": "frustrated", "-_-": "unamused", "-.-": "unamused", "B-)": "cool face", "B)": "cool face", "8-)": "cool face",
    "8)": "cool face", "D:": "horrified", ">:)": "evil grin", ">:-)": "evil grin", "¯\\_(ツ)_/¯": "shrug",
    "(╯°□°)╯︵ ┻━┻": "table flip", "ಠ_ಠ": "disapproval",
}

#: Fixed: names of languages in themselves.
LANGUAGE_NAMES = {
    "af": "Afrikaans", "ar": "العربية", "bg": "Български", "bn": "বাংলা", "ca": "Català", "cs": "Čeština", "cy": "Cymraeg",
    "da": "Dansk", "de": "Deutsch", "el": "Ελληνικά", "en": "English", "es": "Español", "et": "Eesti", "eu": "Euskara",
    "fa": "فارسی", "fi": "Suomi", "fr": "Français", "ga": "Gaeilge", "gl": "Galego", "he": "עברית", "hi": "हिन्दी",
    "hr": "Hrvatski", "hu": "Magyar", "hy": "Հայերեն", "id": "Indonesia", "is": "Íslenska", "it": "Italiano", "ja": "日本語",
    "ka": "ქართული", "ko": "한국어", "lt": "Lietuvių", "lv": "Latviešu", "ms": "Melayu", "nb": "Norsk bokmål",
    "nl": "Nederlands", "pl": "Polski", "pt": "Português", "ro": "Română", "ru": "Русский", "sk": "Slovenčina",
    "sl": "Slovenščina", "sq": "Shqip", "sr": "Српски", "sv": "Svenska", "sw": "Kiswahili", "ta": "தமிழ்", "th": "ไทย",
    "tr": "Türkçe", "uk": "Українська", "vi": "Tiếng Việt", "zh": "中文",
}
#: Fixed: names of scripts.
SCRIPT_NAMES = {
    "CYRILLIC": "Cyrillic", "ARABIC": "Arabic", "HEBREW": "Hebrew", "GREEK": "Greek", "DEVANAGARI": "Devanagari",
    "BENGALI": "Bengali", "THAI": "Thai", "GEORGIAN": "Georgian", "ARMENIAN": "Armenian", "HANGUL": "Hangul (Korean)",
    "CJK": "CJK (Chinese/Japanese/Korean)", "IPA": "IPA (International Phonetic Alphabet)", "BRAILLE": "Unicode Braille (dot patterns)",
}

#: Names of emoji sequences by language: an input of the rewriters. These are a small default; pass a fuller table.
EMOJI_NAMES = {
    "en": {
        "😀": "grinning face", "👨‍👩‍👧": "family man woman girl", "👨‍👩‍👧‍👦": "family man woman girl boy", "🇬🇧": "United Kingdom",
        "👨": "man", "👩": "woman", "👧": "girl", "👦": "boy", "❤️": "red heart", "❤": "red heart", "👍": "thumbs up", "✨": "sparkles",
    },
    "de": {
        "😀": "grinsendes gesicht", "👨‍👩‍👧": "familie mann frau mädchen", "👨‍👩‍👧‍👦": "familie mann frau mädchen junge",
        "🇬🇧": "vereinigtes königreich", "👨": "mann", "👩": "frau", "👧": "mädchen", "👦": "junge", "❤️": "rotes herz",
        "❤": "rotes herz", "👍": "daumen hoch", "✨": "funkelnde sterne",
    },
}
