"""Language marker words and look-alike maps (fixed values, stated as text)."""

UK_WORDS = (
    "та це як що вже чи або але щоб якщо тому коли зараз кошти гроші посилання посиланням підтвердіть підтвердити перейдіть перейти отримати отримання будь ласка дякую привіт доброго дня свій свого вашого вашій замовлення оголошення картки карткою картці виплата виплату виплати рахунок рахунку безпечна угода оформив оформила відправка відправлення доставка доставку прізвище дівоче шафа шафи підпал залізниці вкажіть надішліть"
).split()
RU_WORDS = (
    "это как что уже или но чтобы если поэтому когда сейчас средства деньги денег ссылка ссылку ссылке ссылкой подтвердите подтвердить перейдите перейти получить получение пожалуйста спасибо привет добрый день свой своего вашего вашей заказ заказа объявление карты картой карте выплата выплату выплаты счет счета безопасная сделка оформил оформила отправка отправление доставка доставку фамилия девичья шкаф шкафа поджог железной дороге укажите отправьте перевода здесь неудобно договоримся"
).split()
EN_WORDS = (
    "the is and to for you your please payment order link verify verification card delivery funds money receive confirm already payout safe secure click follow here account check message chat"
).split()

# Look-alikes mapped to Cyrillic before matching, and the wider set of the name folding.
LOOKALIKE_FROM, LOOKALIKE_TO = "aceopxyi01346", "асеорхуіоізчб"
FOLD_FROM, FOLD_TO = "aceopxyiskmhbt", "асеорхуіскмнвт"
CYR_TO_LAT = {
    "щ": "shch", "є": "ye", "ж": "zh", "ї": "yi", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "ю": "yu", "я": "ya",
}
CYR_SINGLE_FROM, CYR_SINGLE_TO = "абвгґдезійклмнопрстуфыэьъ", "abvhgdeziyklmnoprstufye"
LAT_DIGRAPHS = [
    ("shch", "щ"), ("sh", "ш"), ("ch", "ч"), ("ts", "ц"), ("zh", "ж"), ("kh", "х"),
    ("yu", "ю"), ("ya", "я"), ("ye", "є"), ("yi", "ї"), ("x", "кс"),
]
LAT_SINGLE_FROM, LAT_SINGLE_TO = "abvwghdezyijklmnoprstuf", "абввггдезиійклмнорпрстуф".replace("рпр", "рр")
INVISIBLE = "\u200b\u200c\u200d\ufeff\u2060\u202a\u202b\u202c\u202d\u202e\u00a0"
