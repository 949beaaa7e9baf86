"""REL-6..8: routing of chat messages to fixed replies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as tx

ABOUT, OUT_OF_SCOPE = "AboutApp", "OutOfScope"

# Legal signals; with one of these a question goes to retrieval.
LEGAL = (
    "mehnat", "fuqarolik", "fuqaro", "kodeks", "shartnoma", "ish haqi", "ishhaqi", "oylik", "maosh",
    "ta'til", "tatil", "bo'shat", "boshat", "xodim", "ishchi", "ish beruvchi", "ishberuvchi", "bandlik",
    "majburiyat", "da'vo", "davo", "sud", "modda", "qonun", "huquq", "artikl", "kompensats", "ish staji",
    "ish vaqti", "dam olish", "meros", "ijara", "mulk", "vasiyat", "nikoh", "aliment", "jarima", "intizom",
    "ishga qabul", "ishdan", "bekor qilish", "ishga kirish", "ishga olish", "labor code", "labour code",
    "civil code", "employment", "dismissal", "vacation", "article ", "трудов", "гражданск", "кодекс",
    "стать", "зарплат", "отпуск", "увольн", "работник", "работодател", "договор", "компенсац",
    "имуществ", "наследств",
)
# Cues about the assistant that win even beside a legal word.
STRONG_ABOUT = (
    "dastur haqida", "ilova haqida", "bu dastur", "bu ilova", "who are you", "who made you",
    "who built you", "what can you do", "about this app", "about the app",
)
# Cues about the assistant that count only without a legal word.
SOFT_ABOUT = (
    "sen kim", "siz kim", "sen kimsan", "siz kimsiz", "o'zing haqida", "ozing haqida", "o‘zing haqida",
    "o'zing haqingda", "nima qila olasan", "nima qila olasiz", "nima qila oladi", "nima qila olasizlar",
    "qanday yordam berasan", "qanday yordam berasiz", "qanday yordam bera olasan", "imkoniyatlaring nima",
    "imkoniyatlaringiz nima", "internet kerakmi", "oflaynmi", "offline misiz", "offline misan",
    "kim yaratdi", "kim yaratgan", "kim ishlab chiq", "kim ishlab chiqqan", "who made", "who built",
)
# Clear off-topic cues, also only without a legal word.
OFF_TOPIC = (
    "ob-havo", "ob havo", "weather", "погода", "bugungi yangilik", "yangiliklar", "poytaxti", "capital of",
    "who is the president", "prezident kim", "futbol", "football", "basketball", "sport natija",
    "film tavsiya", "kino tavsiya", "serial", "hazil ayt", "joke", "she'r yoz", "she’r yoz", "sher yoz",
    "write a poem", "retsept", "recipe", "ovqat pishir", "python kod", "javascript", "kod yozib ber",
    "write code", "2+2", "2 + 2", "solve this equation", "chatgpt", "openai", "google qidir",
    "internetdan top", "browsedan",
)


@dataclass(frozen=True)
class Assistant:
    """The deployment's own names; cues and replies that mention them are built from here."""

    name: str = "corpusflow"
    maker: str = ""

    def about_cues(self) -> tuple[str, ...]:
        n = self.name.lower()
        made = (f"{n} ai", f"{n} nima", f"{n} haqida", f"what is {n}", f"about {n}")
        return STRONG_ABOUT + made + ((self.maker.lower(),) if self.maker else ())

    def replies(self) -> dict[str, str]:
        return {
            ABOUT: f"{self.name}: O‘zbekiston qonunchiligi bo‘yicha yordamchi. Mehnat kodeksi va Fuqarolik "
                   "kodeksi doirasida ishlaydi.",
            OUT_OF_SCOPE: f"{self.name} faqat Mehnat kodeksi va Fuqarolik kodeksi bo‘yicha savollarga javob "
                          "beradi. Boshqa mavzular qamrovga kirmaydi.",
        }


def _any(text: Column, cues: tuple[str, ...]) -> Column:
    # One alternation: the text is scanned once, not once per cue.
    return text.rlike("|".join(r"\Q" + c + r"\E" for c in cues))


def static_intent(normalized: Column, assistant: Assistant = Assistant()) -> Column:
    """REL-6 on a STR-6 text: 'AboutApp', 'OutOfScope' or null (retrieve and generate)."""
    return (F.when(normalized == "", None)
            .when(_any(normalized, assistant.about_cues()), ABOUT)
            .when(_any(normalized, LEGAL), None)
            .when(_any(normalized, SOFT_ABOUT), ABOUT)
            .when(_any(normalized, OFF_TOPIC), OUT_OF_SCOPE))


def route(messages: DataFrame, text_col: str, assistant: Assistant = Assistant()) -> DataFrame:
    """REL-7, REL-6: drop blank messages, add ``intent``."""
    return (messages.where(~tx.is_blank(text_col))
            .withColumn("_n", tx.normalize_for_intent(text_col))
            .withColumn("intent", static_intent(F.col("_n"), assistant)).drop("_n"))


def static_answers(routed: DataFrame, assistant: Assistant = Assistant()) -> DataFrame:
    """REL-8: fixed replies for the routed messages that have an intent."""
    replies = assistant.replies()
    answer = F.when(F.col("intent") == ABOUT, replies[ABOUT]).otherwise(replies[OUT_OF_SCOPE])
    return (routed.where(F.col("intent").isNotNull())
            .withColumn("answer", answer).withColumn("stop_reason", F.lit("static")))
