"""Known hosts (fixed values) and the invented ones the fixtures use."""

GATEWAYS = """
liqpay.ua
www.liqpay.ua
portmone.com.ua
www.portmone.com.ua
portmone.com
www.portmone.com
wayforpay.com
www.wayforpay.com
novapay.ua
www.novapay.ua
ipay.ua
www.ipay.ua
easypay.ua
www.easypay.ua
fondy.ua
fondy.eu
plata.me
privat24.ua
next.privat24.ua
secure.privatbank.ua
monobank.ua
checkout.monobank.ua
api.monobank.ua
pay.alfabank.com.ua
sensebank.com.ua
oschadbank.ua
pumb.ua
stripe.com
checkout.stripe.com
js.stripe.com
paypal.com
www.paypal.com
checkout.paypal.com
braintreepayments.com
adyen.com
pay.google.com
apple.com
pay.example.net
""".split()
WHITELIST = """
google.com
www.google.com
olx.ua
www.olx.ua
prom.ua
www.prom.ua
privatbank.ua
next.privat24.ua
monobank.ua
novaposhta.ua
rozetka.com.ua
facebook.com
www.facebook.com
instagram.com
telegram.org
web.telegram.org
viber.com
whatsapp.com
web.whatsapp.com
github.com
youtube.com
www.youtube.com
youtu.be
diia.gov.ua
example.org
""".split()
MONITORED = """
olx.ua
www.olx.ua
prom.ua
www.prom.ua
facebook.com
www.facebook.com
localhost
127.0.0.1
thther.example.org
""".split()
USER_ALLOWED = ["allowed.example.com"]

# Words in field descriptions that ask for a listed item, by category.
FIELD_KEYWORDS = [
    ("MOTHER_MAIDEN_NAME", ['дівоче', 'дівоче прізвище', 'прізвище матері', 'дівоче прізвище матері', 'дівочепрізвище', 'maiden', 'maiden name', "mother's maiden name", 'mother maiden', 'maidenname', 'mothersmaidenname', 'девичья фамилия', 'девичья фамилия матери', 'фамилия матери', 'девичья']),
    ("TAX_ID", ['рнокпп', 'іпн', 'ідентифікаційний код', 'податковий номер', 'код платника', 'податковий код', 'tax id', 'tax number', 'inn', 'ssn', 'taxpayer number', 'national tax', 'taxid', 'taxnumber', 'инн', 'идентификационный код', 'налоговый номер', 'код налогоплательщика']),
    ("SECRET_WORD", ['кодове слово', 'секретне слово', 'слово-пароль', 'контрольне слово', 'кодовеслово', 'секретнеслово', 'codeword', 'secret word', 'security word', 'passphrase', 'control word', 'secretword', 'кодовое слово', 'секретное слово', 'слово-пароль', 'контрольное слово']),
    ("PASSPORT_ID", ['номер паспорта', 'серія паспорта', 'id картка', 'паспортні дані', 'номер документа', 'passport number', 'passport series', 'id card number', 'national id', 'document number', 'passport id', 'номер паспорта', 'серия паспорта', 'id карта', 'паспортные данные', 'номер документа']),
    ("DATE_OF_BIRTH", ['дата народження', 'день народження', 'число народження', 'рік народження', 'date of birth', 'birth date', 'dob', 'birthday', 'birth year', 'дата рождения', 'день рождения', 'число рождения', 'год рождения']),
    ("FINANCIAL_PHONE", ['фінансовий номер', 'прив’язаний телефон', 'привязаний телефон', 'номер телефону банку', 'основний номер', 'фінансовий телефон', 'financial phone', 'registered phone', 'bank mobile', 'verified number', 'primary phone', 'финансовый номер', 'привязанный телефон', 'номер телефона банка', 'основной телефон', 'финансовый телефон']),
    ("FATHER_NAME", ['ім’я батька', "ім'я батька", 'по батькові', 'прізвище батька', 'по-батькові', "father's name", 'father name', 'patronymic', 'middle name', 'имя отца', 'отчество', 'фамилия отца']),
]

# Ordinary words that only look like payment words.
PLAIN_WORDS = ("company companies panel panels span spans japan japanese expand expanded expansion panic companion companions pancake panorama participant participants pantry trepan shipping opinion opinions pinned pinning pine pineapple pink alpine spinning spine passport passports passenger passengers compass compasses bypass bypasses passage passages passive passing trespass experience experiences expert experts expense expenses export exports explain explanation expression expressions expected expectations").split()

# Pressure phrases.
URGENCY = [
    (r"(кошти|гроші)\s+(будуть\s+)?повернут[іи]\s+(відправнику|покупцю)", "погроза_повернення_коштів"),
    (r"(замовлення|угод[ау]|виплат[ау]|резерв)\s+(буде\s+)?(анульован|скасован)", "погроза_анулювання"),
    (r"(термін\s+дії|час\s+на\s+підтвердження)\s+(спливає|закінчується|вийшов)", "спливання_терміну"),
    (r"(залишилось|залишилося|діє\s+лише|дійсн[ао]\s+протягом)\s+(\d+|\w+)", "обмежений_час"),
    (r"(негайно|терміново)\s+(підтвердіть|введіть|заповніть|завершіть)", "заклик_до_поспіху"),
    (r"(до\s+скасування|до\s+анулювання|до\s+блокування)\s+залишилось", "залякування_скасуванням"),
    (r"(средства|деньги)\s+(будут\s+)?возвращен[ыа]\s+(отправителю|покупателю)", "ru_угроза_возврата_средств"),
    (r"(заказ|сделк[ау]|выплат[ау]|резерв)\s+(будет\s+)?(аннулирован|отменен)", "ru_угроза_аннулирования"),
    (r"(срок\s+действия|время\s+на\s+подтверждение)\s+(истекает|заканчивается|вышло)", "ru_истечение_срока"),
    (r"(осталось|действует\s+только|действительн[оа]\s+в\s+течение)\s+(\d+|\w+)", "ru_ограниченное_время"),
    (r"(немедленно|срочно)\s+(подтвердите|введите|заполните|завершите)", "ru_призыв_к_спешке"),
    (r"(до\s+отмены|до\s+аннулирования|до\s+блокировки)\s+осталось", "ru_запугивание_отменой"),
    (r"(order|payment|payout)\s+(will\s+be\s+cancelled|expires\s+in|expires\s+soon)", "en_urgency_pressure"),
    (r"(time\s+remaining|hurry\s+up|limited\s+time\s+only|act\s+now)", "en_time_scarcity"),
    (r"(immediately|urgently)\s+(confirm|enter|fill|complete|verify)", "en_urgency_call"),
]
