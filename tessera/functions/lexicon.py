"""Word lists, patterns and tables that the text rules take as defaults.

Each is a parameter of the function that uses it; callers bring longer lists of their own.
"""

# Combining marks that normalisation removes, as a character class.
DIACRITICS = "\\u0610-\\u061A\\u064B-\\u065F\\u0670\\u06D6-\\u06DC\\u06DF-\\u06E4\\u06E7\\u06E8\\u06EA-\\u06ED"
DIACRITICS_VIEWER = "\\u064B-\\u0652"

# Affixes of the light stemmer.
PREFIXES = ("وال", "بال", "فال", "كال", "لل", "ال", "و", "ف", "ب", "ك", "ل", "س")
SUFFIXES = ("ونه", "وها", "وهم", "تهم", "تها", "كم", "هم", "ها", "ون", "ين", "ات", "ان", "ته", "تي", "ني", "نا", "كن", "هن", "وا", "ة", "ه", "ي", "ت", "ن", "ا")

# Words that tokens leave out.
STOP_WORDS = (
    "حدثنا", "حدثني", "أخبرنا", "أخبرني", "أنبأنا", "أنبأني", "روى", "رواه", "ذكر", "سمعت", "سمعنا", "عن", "من", "إلى", "بن", "أبي", "أبو", "بنت",
    "ابن", "ابنة", "أم", "في", "على", "مع", "قال", "قالت", "أن", "إن", "لا", "ما", "هو", "هي", "هم", "هن", "أنا", "نحن", "أنت", "أنتم", "كان", "كانت",
    "كانوا", "يكون", "ذلك", "هذا", "هذه", "تلك", "الذي", "التي", "الذين", "وقد", "قد", "لم", "لن", "لقد", "كل", "بعض", "عليه", "عليها", "عليهم", "له",
    "لها", "لهم", "به", "بها", "بهم", "منه", "منها", "منهم", "فيه", "فيها", "وسلم", "صلى", "الله", "رسول", "النبي", "عنه", "عنها", "رضي", "ال", "و",
    "ف", "ب", "ك", "ل", "إله", "إلا", "يا", "أو", "بل", "ثم", "حتى", "إذا", "لما", "لو", "لولا", "كذلك", "أيضا", "إنما", "إنه", "وإن", "فإن", "وكان",
    "فقال", "وقال", "قلت", "قلنا",
)

# Patterns of rule classes, markers of circumstances, words of topics.
RULES = {
    "prohibition": ("نَهَى", "نهى", "لا يحل", "حرام", "لا يجوز", "حُرِّمَ"),
    "obligation": ("أُمِرْ", "أمر", "فرض", "وجب", "يجب", "افترض"),
    "permission": ("أحل", "أباح", "رخص", "لا بأس", "جائز"),
    "reward": ("من فعل", "من قال", "من صلى", "له أجر", "غفر"),
    "fitra": ("من الفطرة", "السنة", "سنة النبي"),
    "warning": ("ويل", "عذاب", "لعن", "لعنة", "يلعن"),
    "prophecy": ("يأتي زمان", "سيكون", "يكون", "من أشراط", "آخر الزمان"),
}
CIRCUMSTANCES = {
    "time": ("رمضان", "الجمعة", "العيد", "الحج", "ليلة القدر", "السحر", "الفجر", "الظهر", "العصر", "المغرب", "العشاء", "يوم القيامة"),
    "place": ("المسجد", "الكعبة", "المدينة", "مكة", "الحرم", "السفر", "الغزو", "البيت", "المنبر", "الطريق"),
    "trigger": ("جاء رجل", "سئل النبي", "سألت", "قيل يا رسول", "فسألته", "فقال رجل", "جاءت امرأة"),
}
TOPICS = {
    "prayer": ("صلاة", "صلى", "ركوع", "سجود", "قيام", "وضوء", "طهارة", "أذان", "إمام", "مسجد", "قبلة", "ركعة", "تشهد", "فاتحة"),
    "fasting": ("صوم", "صام", "رمضان", "إفطار", "سحور", "اعتكاف", "صيام"),
    "zakat": ("زكاة", "صدقة", "عشر", "نصاب", "فقير", "مسكين"),
    "hajj": ("حج", "عمرة", "إحرام", "طواف", "سعي", "كعبة", "منى", "عرفة", "مزدلفة"),
    "family": ("نكاح", "زواج", "طلاق", "مهر", "نفقة", "رضاع", "حضانة", "ولادة", "زوج", "زوجة", "أرملة"),
    "trade": ("بيع", "شراء", "ربا", "دين", "قرض", "رهن", "إجارة", "تجارة"),
    "character": ("صدق", "كذب", "أمانة", "خيانة", "غيبة", "نميمة", "حسد", "كبر", "تواضع", "رحمة", "عدل", "ظلم"),
    "jihad": ("جهاد", "غزو", "قتال", "شهيد", "فتح", "سلاح", "سرية"),
    "food": ("حلال", "حرام", "ذبح", "صيد", "خمر", "خنزير", "ميتة", "دم"),
    "death": ("موت", "قبر", "جنازة", "دفن", "صلاة الجنازة", "بكاء", "وصية"),
    "eschatology": ("قيامة", "حساب", "ميزان", "جنة", "نار", "صراط", "حوض", "شفاعة"),
    "knowledge": ("علم", "تعلم", "فقه", "قرآن", "حديث", "رواية", "إجازة"),
}

# What ends the chain of transmitters and begins the body, tried in this order.
BODY_STARTS = (
    "أَنَّ\\s+(?:النَّبِيَّ|رَسُولَ اللَّهِ|النبي|رسول الله)\\s+(?:صَلَّى|صلى)[^،]*?قَالَ[:\\s]",
    "أن\\s+(?:النبي|رسول الله)\\s+قال[:\\s]",
    "سَمِعْتُ\\s+(?:النَّبِيَّ|رَسُولَ اللَّهِ|النبي|رسول الله)",
    "سمعت\\s+(?:النبي|رسول الله)",
    "قَالَ\\s+(?:النَّبِيُّ|رَسُولُ اللَّهِ|النبي|رسول الله)",
)
BODY_QUOTES = "«»\"'‹›:،؛ "

# Grades from strong to weak, their strengths, and words that raise an unknown grade.
GRADES = ("companion", "reliable", "mostly_reliable", "weak", "abandoned", "fabricator", "unknown")
STRENGTH = {"companion": 6, "reliable": 5, "mostly_reliable": 4, "weak": 3, "abandoned": 2, "fabricator": 1, "unknown": 0}
GRADE_WORDS = (
    ("abandoned", ("متروك", "كذاب", "وضاع", "موضوع", "ساقط")),
    ("weak", ("ضعيف", "فيه لين", "فيه ضعف", "لين", "منكر")),
    ("mostly_reliable", ("صدوق", "لا بأس", "مقبول", "حسن الحديث", "صالح")),
    ("reliable", ("ثقة", "ثبت", "إمام", "متقن", "حافظ", "جليل", "أتقن", "وثقه", "احتج به")),
)
#: Strength by grade code of a chain's member, and verdicts by the least strength.
CHAIN_STRENGTH = {1: 5, 2: 5, 3: 4, 4: 3, 5: 2, 6: 2, 7: 1, 8: 0, 9: 0, 10: -1, 0: -1}
VERDICTS = ((3, "sahih"), (2, "hasan"), (1, "daif"))

# Verbs that part a chain, relatives named in place of a name, words that are no name.
CHAIN_VERBS = ("حدثنا", "حدثني", "حدثه", "اخبرنا", "اخبرني", "سمعت", "سمعنا", "انبانا", "عن")
RELATIVES = (
    "عمه", "عمي", "عمته", "عمتي", "أمه", "أمي", "أخيه", "أخي", "أخته", "أختي", "خاله", "خالي", "خالته", "خالتي", "ابنه", "ابني", "ابنته", "ابنتي",
    "جدته", "جدتي", "زوجها", "زوجي", "زوجته", "مولاه", "مولاي", "مولاته", "مولاها",
)
NO_NAMES = ("الله", "رسول", "النبي", "ذلك", "هذا", "كان")
ARTIFACTS = ("يقول", "حدثنا", "حدثني", "أخبرنا", "سمعت", "قال ", "قال:", "عن فلان", "عنه", "عنها", "رضي الله")

# Number words and their values, and words that end a number.
NUMBERS = {
    "واحد": 1, "واحدة": 1, "إحدى": 1, "احدى": 1, "اثنين": 2, "إثنين": 2, "اثنتين": 2, "إثنتين": 2, "اثنى": 2, "إثنى": 2, "اثنتى": 2, "ثلاث": 3, "ثلاثة": 3, "أربع": 4, "اربع": 4, "أربعة": 4, "اربعة": 4, "خمس": 5, "خمسة": 5, "ست": 6, "ستة": 6, "سبع": 7, "سبعة": 7, "ثمان": 8, "ثماني": 8, "ثمانية": 8, "تسع": 9, "تسعة": 9,
    "عشر": 10, "عشرة": 10, "عشرين": 20, "ثلاثين": 30, "أربعين": 40, "اربعين": 40, "خمسين": 50, "ستين": 60, "سبعين": 70, "ثمانين": 80, "تسعين": 90,
    "مائة": 100, "مئة": 100, "مائتين": 200, "مئتين": 200,
}
NUMBER_STOPS = (
    "في", "من", "أو", "او", "بمكة", "بالمدينة", "بمصر", "بالبصرة", "بالكوفة", "بدمشق", "ببغداد", "وهو", "وله", "وقد", "وكان", "وقيل", "رحمه", "خلافة",
    "بين", "على", "قال",
)
DEATH_VERBS = ("مات", "توفي", "توفى", "قتل")

# Kunyas too common to tell persons apart; generations and last years that fit a grade.
COMMON_KUNYAS = (
    "ابو عبد الله", "ابو محمد", "ابو بكر", "ابو الحسن", "ابو علي", "ابو الفضل", "ابو العباس", "ابو الحسين", "ابو عمر", "ابو القاسم", "ابو سعيد", "ابو عمرو",
    "ابو جعفر", "ابو الخير", "ابو ابراهيم", "ابو يوسف", "ابو عبد الرحمن", "ابو حفص", "ابو اسحاق", "ابو موسى", "ابو هريرة", "ابو سلمة", "ابو زرعة", "ابو حاتم",
    "ابو نصر", "ابو طالب", "ابو الطيب", "ابو منصور",
)
GENERATIONS = {"companion": (1, 1), "very_reliable": (2, 10), "reliable": (2, 11), "mostly_reliable": (2, 12), "acceptable": (2, 12), "slightly_weak": (2, 12), "weak": (2, 12), "fabricator": (2, 12), "abandoned": (2, 12)}
LAST_YEARS = {"companion": 110, "very_reliable": 300, "reliable": 400, "mostly_reliable": 400, "acceptable": 400}
