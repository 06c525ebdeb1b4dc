"""Patterns for request relations.

Fixed values: stated as text because results must equal the rule set's.
Word boundaries are added by the callers.
"""

ACTION = r"передавши|передаючи|надішліть|надішли|надіслати|надсилайте|відправте|відправ|відправити|завантажте|завантаж|повідомте|повідомляйте|просить|asks?|покажіть|покажите|впишіть|впишите|заповніть|заполните|додайте|добавьте|повідом|повідомивши|напишіть|напиши|вкажіть|вкажи|скиньте|скинь|скажіть|скажи|підкажіть|підкажи|надайте|надай|продиктуйте|продиктуй|введіть|введи|ввести|вводьте|вишліть|дайте|дай|назвіть|назви|назвати|передайте|передай|передати|перешліть|перешли|поділіться|потрібен|потрібна|потрібні|треба|яке|яка|напишите|напиши|укажите|укажи|скиньте|скажите|скажи|предоставьте|продиктуйте|введите|вышлите|пришлите|отправьте|отправь|загрузите|сообщите|сообщайте|сообщив|передайте|перешлите|дайте|назовите|нужен|нужна|нужны|надо|какая|какое|send|share|provide|upload|enter|tell|type|give|submit|forward|disclose|need|what\s+is"
NEGATION = r"(?:^|\s)(?:не(?:\s+(?:потрібно|треба|варто|слід|можна|нужно|надо|стоит))?|ніколи\s+не|никогда\s+не|never|do\s+not|dont|don't|should\s+not|shouldnt|shouldn't)\s*$"
EXPLANATORY = r"(?:інструкці|инструкци|статт|стать|довід|список|опис|описание|приклад|пример|guide|article|example|explanation|list\s+of)"
NOT_REQUESTED = r"(?:ніколи|никогда|never)\s+(?:не\s*)?(?:просить|asks?)(?:\s+you)?(?:\s+to)?[^.!?\n]{0,80}$"
REPORTED = r'(?:приклад|пример|example|цитата|quote|фраза|phrase|шаблон|template)[^.!?\n]{0,80}[:«"“]\s*$|(?:шахрай|мошенник|scammer)\s+(?:написав|написал|пише|пишет|просить|просит|wrote|said|asks?)[^.!?\n]{0,80}[:«"“]\s*$'
PAYMENT_PURPOSE = r"(?:підтвердження\s+переказ[а-яіїє]*|подтверждения\s+перевод[а-яё]*|(?:отримати|отримання|зарахування|виплат[а-яіїєё]*|переказу|получить|получения|зачисления|перевода)\s+(?:оплат[а-яіїє]*|кошт[а-яіїє]*|грош[а-яіїє]*|виплат[а-яіїєё]*|средств|денег)|(?:receive|collect|claim|confirm)\s+(?:your\s+)?(?:payment|payout|money|funds|transfer))"
VERIFICATION_PURPOSE = r"(?:перевір[а-яіїє]*|підтверд[а-яіїє]*|верифікац[а-яіїє]*|віднов[а-яіїє]*|скасуванн[а-яіїє]*|зупинити|розблокуванн[а-яіїє]*|провер[а-яё]*|подтверд[а-яё]*|верификац[а-яё]*|восстанов[а-яё]*|verify|verification|confirm|restore|recover)\s+(?:(?:ваш[а-яіїєё]*|свій|your|the)\s+)?(?:покупк[а-яіїє]*|замовленн[а-яіїє]*|профіл[а-яіїє]*|акаунт[а-яіїє]*|особ[а-яіїє]*|операці[а-яіїє]*|переказ[а-яіїє]*|вхід|доступ[а-яіїє]*|карт[а-яіїєё]*|плат[а-яіїєё]*|аккаунт[а-яё]*|профил[а-яё]*|личност[а-яё]*|account|profile|identity|login|access|card|payment)|(?:для|for|to)\s+(?:завершення\s+)?(?:перевірки|верифікації|проверки|верификации|verification)|(?:скасування|зупинення)\s+підозрілої\s+операці[їи]"
OBJECT_WALLET_SECRET = r"(?:с[іи]д|s[еe]{2}d)\s*ф[рp][аa]з[а-яіїєёa-z]*|s[еe]{2}d\s*[рp]hr[аa]s[еe]|s[еe][сc]r[еe]t\s*r[еe][сc][оo]v[еe]r[уy](?:\s*[рp]hr[аa]s[еe])?|мнемон[іи]ч[а-яіїєё]*\s+фраз[а-яіїєё]*|резервн[а-яіїєё]*\s+фраз[а-яіїєё]*|приватн[а-яіїєё]*\s+ключ[а-яіїєё]*|private\s+key|[рp]r[іi]v[аa]t[еe]\s+k[еe][уy]|(?:12|і2|24|2ч)\s*(?:секретн[а-яіїєё]*\s+)?(?:слів|слова|слов|words)|секретн[а-яіїєё]*\s+ключ[а-яіїєё]*|пароль\s+(?:від\s+|от\s+)?(?:вашого\s+|вашего\s+)?(?:крипто)?(?:гаманц[а-яіїє]*|кошельк[а-яё]*)|wallet\s+password|password\s+(?:for|of)\s+(?:your\s+)?wallet"
OBJECT_PAYMENT_SECRET = r"[cс]v[vвcс]|[pр][iі]n(?:\s*(?:код|code))?|код\s+(?:(?:одноразов[а-яіїєё]*|входу|підтвердження|подтверждения|безпеки|безопасности)|(?:з|із|из)\s*(?:sms|смс|банківського\s+повідомлення))|(?:sms|смс)[ -]?код|(?:одноразов[а-яіїєё]*|одноразов[а-яё]*|one\s*time)\s+(?:код|пароль\s+(?:из|з)\s*sms|code|password)|(?:sms|confirmation|security|login)\s+code|otp|баланс(?:\s+(?:на\s+)?карт[а-яіїєё]*)?|(?:card|available)\s+balance|(?:дані|реквізити|данные|реквизиты)\s+(?:(?:вашої|вашей)\s+)?карт[а-яіїєё]*|(?:термін|строк)\s+дії\s+карт[а-яіїє]*|срок\s+действия\s+карт[а-яё]*|card\s+(?:details|credentials|expiry)|фото\s+карт[а-яіїєё]*\s+з\s+обох\s+боків|карт[а-яіїє]*\s+з\s+лицьового\s+(?:й|і|та)\s+зворотного\s+боку|(?:три|3)\s+цифр[а-яіїєё]*\s+(?:з|із|со)\s+(?:її\s+)?зворот[а-яіїєё]*|(?:16|іб)\s+цифр[а-яіїєё]*|номер\s+карт[а-яіїєё]*"
# A bare "код" counts when this follows within 100 characters.
CODE_FOLLOWED_BY = r"(?:надійш[а-яіїєё]*|прийш[а-яіїєё]*|телефон|підозріл[а-яіїєё]*\s+операц[а-яіїєё]*|зарахуван[а-яіїєё]*|переказ[а-яіїєё]*)"
OBJECT_ACCOUNT_PASSWORD = r"парол[а-яіїєё]*|[рp][аa]ssw[оo]rd|pwd|passcode"
OBJECT_IDENTITY = r"паспорт[а-яіїєё]*|посвідчення\s+особи|удостоверени[ея]\s+личности|(?:номер|серію|серию)\s+(?:вашого\s+|вашего\s+)?документ[а-яіїєё]*|ід\s*картк[а-яіїє]*|айді|айди|idкартк[а-яіїєё]*|іdкартк[а-яіїєё]*|passport(?:\s+(?:number|details))?|id\s*card|identity\s+document|national\s+id|іпн|рнокпп|инн|ідентифікаційн[а-яіїє]*\s+код|идентификационн[а-яё]*\s+код|податков[а-яіїє]*\s+номер|налогов[а-яё]*\s+номер|tax\s+id|ssn|social\s+security\s+number|дівоч[а-яіїє]*\s+прізвищ[а-яіїє]*(?:\s+матері)?|девич[а-яё]*\s+фамили[яию](?:\s+матери)?|(?:mother'?s?|mothers|mom'?s?|moms)\s+maiden\s+name|(?:кодове|секретне|контрольне|кодовое|секретное|контрольное)\s+слово|(?:security|secret|control)\s+word|відповід[а-яіїє]*\s+на\s+(?:контрольн[а-яіїє]*|секретн[а-яіїє]*)\s+(?:питання|запитання)|ответ\s+на\s+(?:контрольный|секретный)\s+вопрос|(?:answer\s+to\s+(?:your\s+)?)?security\s+question|(?:дат[а-яіїє]*|день|рік)\s+народження|(?:дат[а-яё]*|день|год)\s+рождения|date\s+of\s+birth|birth\s+date|dob|повне\s+імя"
SIGNAL_ACTION = r"надішл[а-яіїє]*|надсил[а-яіїє]*|скин[а-яіїє]*|скид[а-яіїє]*|переда[а-яіїє]*|повідом[а-яіїє]*|продикту[а-яіїє]*|вкаж[а-яіїє]*|напиш[а-яіїє]*|залиш[а-яіїє]*|дайте|дай|надай[а-яіїє]*|надайте|сфотограф[а-яіїє]*|фотограф[а-яіїє]*|підтверд[а-яіїє]*|перевір[а-яіїє]*|перейді[а-яіїє]*|перейд[а-яіїє]*|перенес[а-яіїє]*|перенесі[а-яіїє]*|введ[а-яіїє]*|скаж[а-яіїє]*|уточн[а-яіїє]*|відкрий[а-яіїє]*|оформ[а-яіїє]*|потріб[а-яіїє]*|прос[а-яіїє]*|попрос[а-яіїє]*|пита[а-яіїє]*|запита[а-яіїє]*|пропону[а-яіїє]*|обмін[а-яіїє]*|зв[’']?яза[а-яіїє]*|send|share|provide|disclose|upload|enter|tell|give|confirm|verify|move|switch|open|visit|photograph|ask|need|передайте|пришлите|сообщите|укажите|подтвердите|перейдите|де|куди|where|what"
SIGNAL_OBJECTS = [
    ("wallet_secret", r"seed|секретн[а-яіїє]*\s+фраз|фраз[а-яіїє]*\s+відновлення|приватн[а-яіїє]*\s+ключ|private\s+key|recovery\s+phrase"),
    ("secret", r"парол|password|passcode|(?:^|[^a-z0-9_])(?:cvv|cvc|pin|otp)(?:[^a-z0-9_]|$)|код[^.!?]{0,35}(?:sms|смс|банків|повідомлен)|(?:sms|банків)[^.!?]{0,35}код"),
    ("identity", r"паспорт|passport|селфі|selfie|домашн[а-яіїє]*\s+адрес|дат[а-яіїє]*\s+народження|адрес[а-яіїє]*[^.!?]{0,25}(?:близьких|родич)|телефон[а-яіїє]*[^.!?]{0,25}(?:близьких|родич)"),
    ("military_sensitive", r"військов|підрозділ|дислокаці|розташування\s+охорони|службов[а-яіїє]*\s+план|military|troop"),
    ("public_reference", r"номер\s+(?:звернення|замовлення)|публічн[а-яіїє]*\s+(?:звіт|статт|матеріал|адрес)|відкрит[а-яіїє]*\s+(?:репортаж|матеріал)|public\s+(?:report|article|address)|ticket\s+number"),
    ("bank_details", r"реквізит|дан[а-яіїє]*\s+картк|картк|bank\s+details|card\s+details"),
    ("contact", r"контакт|номер\s+телефон|телефон|contact|phone"),
    ("account", r"акаунт|обліков[а-яіїє]*\s+запис|сторінк[а-яіїє]*\s+автора|профіл|кабінет|гаманець|account|wallet"),
    ("location", r"район|адрес|де\s+(?:ви|ти)|населен[а-яіїє]*\s+пункт|локаці|location|address"),
    ("generic_data", r"інформаці|дан[іих]|відомост|підтвердження|сім[’']?[яю]|details|information|family"),
]
