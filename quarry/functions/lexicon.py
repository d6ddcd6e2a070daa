"""Word lists of the language pack. All operators take a ``Pack``; ``TURKISH`` is the default."""

from __future__ import annotations

from dataclasses import dataclass

UNKNOWN = "unknown"

# Suffixes, words without content, typed words of queries and titles.
SUFFIXES = (
    "ları leri lar ler nın nin nun nün ın in un ün daki deki taki teki dan den tan ten da de ta te ya ye yı yi yu yü la le ça çe ca ce "
    "lik lık luk lük cı ci cu cü çı çi çu çü sı si su sü sal sel li lı lu lü ki a e ı i u ü"
).split()
STOP_FUNCTION = "ve ile için bu bir de da den dan te ta ki mi mu mü mı ne ya veya bazı her tüm çok az en daha gibi".split()
STOP_QUERY = (
    "ve ile bir bu da de mi mı mu mü için ama gibi olan her ne ki çok az en set adet ml gr kg cm mm lt ltr li lı lu lü lik lık luk lük no no. numara "
    "erkek kadın unisex bebek çocuk kız oğlan büyük küçük orta kısa uzun"
).split()
GENDER_WORDS = "erkek kadın bayan kız unisex erkekler kadınlar kızlar".split()
AGE_WORDS = "bebek çocuk yetişkin çocuklar bebekler".split()
MATERIAL_WORDS = "pamuk pamuklu deri hakiki polyester yün keten naylon çelik plastik ahşap akrilik viskon modal bambu ipek".split()
COLOURS = (
    "kırmızı mavi beyaz siyah sarı yeşil pembe mor gri turuncu lacivert bej kahverengi altın gold gümüş silver rose ekru krem bordo haki füme antrasit "
    "indigo petrol"
).split()
# Names and families of colours.
COLOUR_SYNONYM = {"gold": "altın", "silver": "gümüş", "rose": "pembe", "krem": "bej", "kiremit": "kırmızı"}
COLOUR_FAMILY = {
    "antrasit": "gri", "füme": "gri", "platin": "gri", "koyu gri": "gri", "açık gri": "gri", "kurşun": "gri", "gri melanj": "gri",
    "lacivert": "mavi", "indigo": "mavi", "petrol": "mavi", "saks mavi": "mavi", "bebe mavisi": "mavi", "açık mavi": "mavi",
    "bordo": "kırmızı", "kiremit": "kırmızı", "altın": "sarı", "gold": "sarı", "gümüş": "metalik", "silver": "metalik", "krem": "bej", "kırık beyaz": "bej", "ekru": "bej",
}
# What a material word stands for.
MATERIAL = {
    "pamuk": "pamuk", "pamuklu": "pamuk", "deri": "deri", "hakiki": "deri", "polyester": "polyester", "yün": "yün", "keten": "keten", "naylon": "naylon",
    "çelik": "çelik", "plastik": "plastik", "ahşap": "ahşap",
}
# The words by which the parser types a token.
PARSE_COLOURS = (
    "beyaz siyah kırmızı mavi yeşil sarı turuncu mor pembe gri kahverengi bej lacivert krem altın gold gümüş silver rose ekru bordo antrasit füme haki "
    "kiremit şampanya mint"
).split()
PARSE_MATERIALS = "deri süet metal plastik ahşap bambu pamuk polyester nylon keten ipek yün kaşmir kadife gümüş altın titanyum paslanmaz seramik cam".split()
PARSE_GENDER = {"kadın": "kadın", "bayan": "kadın", "kız": "kadın", "erkek": "erkek", "bay": "erkek", "unisex": "unisex"}
PARSE_AGE = {"bebek": "bebek", "bebeği": "bebek", "bebeklere": "bebek", "çocuk": "çocuk", "çocuğu": "çocuk", "kids": "çocuk"}
#: (words that follow the number, unit that is emitted), in order of output.
UNITS = (("ml", "ml"), ("lt", "lt"), ("ltr", "lt"), ("gr", "gr"), ("kg", "kg"), ("gb", "gb"), ("tb", "tb"), ("cm", "cm"), ("mm", "mm"), ("inç", "inç"), ("inch", "inç"))
GARMENT_SIZES = "xs s m l xl xxl xxxl 2xl 3xl".split()
# Attribute words of the list-based parser.
LIST_COLOURS = (
    "kırmızı mavi beyaz siyah sarı yeşil pembe mor gri turuncu lacivert bej kahverengi altın gold gümüş silver rose ekru krem bordo haki füme karışık renkli "
    "şeffaf lila pudra antrasit vizon"
).split()
LIST_SIZES = "xs s m l xl xxl 2xl 3xl 4xl 5xl 36 37 38 39 40 41 42 43 44 45 46 47 48 small medium large onesize standart".split()
LIST_MATERIALS = "deri hakiki süet kumaş pamuk keten polyester viskon ipek kadife kaşmir yün akrilik naylon polar şifon saten dantel örgü".split()
LIST_STYLES = "uzun kısa kollu kolsuz yüksek alçak beli dar bol slim klasik spor casual elegant vintage retro modern basic oversize".split()
# The lists on ASCII-folded text.
FOLDED_STOP = "ve ile icin bu bir de da den dan en cok az gibi olan set adet li lu model".split()
FOLDED_GENDER = "kadin bayan erkek kiz unisex".split()
FOLDED_AGE = "bebek cocuk yetiskin genc".split()
FOLDED_COLOURS = (
    "siyah beyaz mavi kirmizi yesil sari pembe mor gri turuncu lacivert bej kahverengi gold altin gumus silver rose ekru krem bordo haki fume antrasit "
    "indigo petrol"
).split()
FOLDED_MATERIALS = "pamuk pamuklu deri polyester yun keten naylon celik plastik ahsap akrilik viskon modal bambu".split()
# Words of accessories.
ACCESSORY_WORDS = (
    "kılıf kapak koruyucu ekran aksesuar şarj kablo tutucu stand uyumlu için compatible cover case yedek parça filtre toner mürekkep kartuş"
).split()
#: Letters of a word, for word-bounded patterns that mean the same in every engine.
LETTERS = "0-9a-zçğıöşü"


@dataclass(frozen=True)
class Pack:
    """The lists that depend on the language of titles and queries."""

    suffixes: tuple[str, ...] = tuple(SUFFIXES)
    stop: tuple[str, ...] = tuple(STOP_FUNCTION)
    gender: tuple[str, ...] = tuple(GENDER_WORDS)
    age: tuple[str, ...] = tuple(AGE_WORDS)
    materials: tuple[str, ...] = tuple(MATERIAL_WORDS)
    colours: tuple[str, ...] = tuple(COLOURS)


TURKISH = Pack()


def suffix_pattern(suffixes: tuple[str, ...] = tuple(SUFFIXES)) -> str:
    """Three letters or more, then a suffix at the end; the lazy start leaves the longest suffix to the second group."""
    by_length = sorted(set(suffixes), key=lambda s: (-len(s), s))
    return f"^(.{{3,}}?)({'|'.join(by_length)})$"


def whole_word(*words: str) -> str:
    """One of the words, between characters that are no letters of a word."""
    return f"(^|[^{LETTERS}])({'|'.join(words)})([^{LETTERS}]|$)"
