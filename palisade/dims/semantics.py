"""Semantic prototypes, signal patterns and concept profiles (fixed values, stated as text)."""

REWARD = r"(?:\$|€|usd|usdt|uah|грн|крипт|биткоин|біткоїн|оплат|заплат|плачу|платим|платимо|тариф|(?:^|[^\p{L}\p{N}])ставк|грош|деньг|бакс|сотк|тысяч|тисяч|тыщ|заробіт|заработ|доход|дохід|заробити|заработать|підробіт|подработ|на карту|на гаманець|на кошелек|на кошелёк|(?:^|[^\p{L}\p{N}])(?:рубл|руб(?:[^а-яіїєё]|$))|фінанс|винагород|кошт|компенсац|премі|бонус|матеріал)"
ACTION = r"(?:робот|работ|підробіт|подработ|підійди|підійдіть|подойди|подойдите|сходи|пойди|сфоткай|сфотографуй|сфотографируй|зроби\s+фото|сделай\s+фото|зробити|зробіть|зробіть|надіслати|надішліть|сфотографувати|зфотографувати|зняти\s+відео|зніміть|сфотографуйте|зніми\s+відео|сними\s+видео|зафільмуй|засними|оглянь|подивись|посмотри|глянь|перевір|проверь|надішли|отправь|скинь|скинеш|скинешь|скинуть|кинь|(?:^|[^\p{L}\p{N}])(?:купи|купіть|купити|купуй|купуйте|купишь|купите)(?:[^\p{L}\p{N}]|$)|розпали|підпали|підпалюєш|подожги|сожги|подж[её]г|закинь|віднеси|отнеси|поклади|положи|прикріпи|прикрепи|курєр|курьер|розвідник|разведчик|розвідк|разведк|завдання|задани|тестов|збираєм|собираем|зафіксуй|зафіксувати|зафиксируй|зафиксировать|введіть|введи|введите|укажите|вкажіть|продиктуй|назвіть|назови|дай|дайте)"
TARGET = r"(?:будівл|здани|споруд|сооружени|обєкт|объект|адміністрац|администрац|стоянц|парковк|стоян|авто|машин|транспорт|бус|номер|(?:^|[^\p{L}\p{N}])(?:хрест|крест)[а-яіїєё]*(?:[^\p{L}\p{N}]|$)|піксель|пиксель|паркан|забор|колі[яї]|рельс|пут[еий]|ж/?д|перегон|релейн|шаф|дріт|провод|веж|вышк|міст|мост|військов|военн|всу|тцк|воєнкомат|военкомат|воєнком|военком|частин|част[иь]|блокпост|патрул|адрес|вулиц|улиц|локац|координат|поверх|склад|завод|інфраструктур|infrastructure|прильот|обстріл|руйнування)"
DISCRETION = r"(?:швидк|быстр|тишк|тихо|втихую|тихар|анонім|аноним|конфіденційн|конфиденциальн|секрет|видали|удали|очисти|безпечно|безопасно|безпек|легко|не бійся|не бойся|ніхто не взнає|ніхто не побачить|никто не узнает|никто не увидит|перевірен|проверен|прямо зараз|прямо сейчас|закрит[а-яіїєё]*\s+канал|таємн|тайн)"
RECON = r"(?:координат|точна\s+адрес|поверх|марк[а-яіїєё]*\s+т?а?\s*номер|номер\s+машин|номер\s+авто|графік\s+виїзд|графік\s+(?:руху|переміщення)\s+(?:військов[а-яіїє]*\s+)?технік|чи\s+є\s+охорон|наявніст[ья]\s+охорон|зафіксувати\s+фото|зробити\s+\S+\s+фото|зробити\s+фото|відеозвіт|фотозвіт|розвіддан|збір\s+даних|розвідк|розвідник|місце\s+прильот|місце\s+обстріл|місце\s+удар|місце\s+руйнування)"
IDEOLOGY_COVER = r"(?:рух[а-яіїєё]*\s+опор|мереж[а-яіїєё]*\s+прямої\s+ді|підпілл|підпільн|каральн[а-яіїєё]*\s+систем|боротьб[а-яіїєё]*\s+з\s+режим|спільн[а-яіїєё]*\s+перемог|однодумець|однодумц)"
CONCEPTS = [
    ("photo", r"фото|сфот|знім|сним|відео|видео|зафільм|засним|кадр|зйомк|съемк"),
    ("vehicle", r"(?:авто|машин|бус|транспорт|номер|піксель|пиксель|(?:^|[^\p{L}\p{N}])(?:хрест|крест)[а-яіїєё]*(?:[^\p{L}\p{N}]|$)|тачк)"),
    ("building", r"будівл|здани|споруд|сооружени|тцк|воєнкомат|военкомат|воєнком|военком|адміністрац|администрац|обєкт|объект|стоянц|парковк|стоян|поверх|склад"),
    ("money", r"грош|деньг|кошт|бакс|дол|usdt|крипт|uah|грн|руб|оплат|плачу|платим|заплат|заробіт|заработ|підробіт|подработ|фінанс|винагород|компенсац"),
    ("task", r"підійди|подойди|піди|пойди|сходи|зроби|сделай|перевір|проверь|оглянь|посмотри|глянь|купи|підпали|подожги|сожги|розпали|завданн|задани|робот|работ|збираєм|собираем|зафіксуй|зафіксувати|зафиксируй|зафиксировать"),
    ("sabotage", r"підпал|поджог|сожги|подожги|розпалювач|розжиг|коктейл|молотов|релейн|шаф|диверс|знищ|уничтож"),
    ("recon", r"координат|точна\s+адрес|поверх|марк[а-яіїєё]*\s+т?а?\s*номер|номер\s+машин|номер\s+авто|графік\s+виїзд|чи\s+є\s+охорон|наявніст[ья]\s+охорон|зафіксувати|розвіддан|збір\s+даних|розвідк|розвідник"),
    ("ideology", r"рух[а-яіїєё]*\s+опор|мереж[а-яіїєё]*\s+прямої\s+ді|підпілл|підпільн|каральн[а-яіїєё]*\s+систем|боротьб[а-яіїєё]*\s+з\s+режим|спільн[а-яіїєё]*\s+перемог|однодумець|однодумц"),
]
PROTOTYPES = [
    ("MILITARY_SABOTAGE_RECRUITMENT", "пропозиція швидкого заробітку криптою або грошима за фотографування, відеозйомку, координати або розвідку будівель, військових обєктів, транспорту"),
    ("MILITARY_SABOTAGE_RECRUITMENT", "підійди за адресою і зроби фото або відео будівлі, машин, номерів авто за грошову винагороду"),
    ("MILITARY_SABOTAGE_RECRUITMENT", "підпал релейних шаф, військових автомобілів, бусів, використання запалювальної суміші за оплату в криптовалюті"),
    ("MILITARY_SABOTAGE_RECRUITMENT", "шукаємо курєрів розвідників для простих завдань з високою щотижневою оплатою на криптогаманець"),
    ("MILITARY_SABOTAGE_RECRUITMENT", "предложение работы в крипте за фотосъемку зданий, военкоматов, машин с номерами или поджог релейного шкафа"),
    ("MILITARY_SABOTAGE_RECRUITMENT", "ищем людей на легкую подработку, оплата в криптовалюте или на карту за фото и видео военкоматов, тцк, техники с крестами"),
    ("MILITARY_SABOTAGE_RECRUITMENT", "подойди по адресу и сфотографируй здание, автомобили с номерами или сделай видеосъемку за вознаграждение в usdt"),
    ("MILITARY_SABOTAGE_RECRUITMENT", "поджог релейного шкафа жд или военных бусов, машин всу за деньги, оплата сразу после видеоотчета"),
    ("MILITARY_SABOTAGE_RECRUITMENT", "купи жидкость для розжига или сделай коктейль молотова и подожги релейный шкаф на перегоне за доллары"),
    ("MILITARY_SABOTAGE_RECRUITMENT", "збираємо координати обєктів місця проживання керівництва тцк стоянки особистих авто склади точна адреса марка номер машини графік виїзду зафіксувати фотографіями"),
    ("MILITARY_SABOTAGE_RECRUITMENT", "рух опору мережа прямої дії допомога в боротьбі з режимом потрібна точна адреса поверх номер авто та фотографії військових або тцк"),
    ("MILITARY_SABOTAGE_RECRUITMENT", "сбор координат объектов места проживания руководства тцк стоянки машин точный адрес номер машины график выезда зафиксировать фото"),
    ("PAYMENT_CREDENTIAL_THEFT", "для підтвердження переказу вкажіть повний номер карти, термін дії, свв код та смс пароль від банку"),
    ("PAYMENT_CREDENTIAL_THEFT", "верифікація платіжної операції вимагає введення секретного коду або підтвердження з повідомлення"),
    ("PAYMENT_CREDENTIAL_THEFT", "для подтверждения перевода укажите номер карты, срок действия, cvv код и смс пароль от банка"),
    ("PAYMENT_CREDENTIAL_THEFT", "для получения выплаты или зачисления средств укажите полный номер банковской карты срок и трехзначный код с обратной стороны"),
    ("PAYMENT_CREDENTIAL_THEFT", "введите код подтверждения из смс или пуш уведомления банка для верификации карты и зачисления средств"),
]

DIMENSIONS = ["reward", "action", "target", "vehicle", "media", "sabotage", "discretion", "messenger", "escrow", "credential"]
PROFILES = {
    "MILITARY_SABOTAGE_RECRUITMENT": [0.85, 0.90, 0.88, 0.82, 0.78, 0.85, 0.70, 0.65, 0.10, 0.15],
    "PAYMENT_CREDENTIAL_THEFT": [0.40, 0.70, 0.10, 0.05, 0.05, 0.05, 0.50, 0.55, 0.60, 0.98],
}

# Signals tested on lower-cased text.
SIGNALS = {
    "reward": REWARD,
    "action": ACTION,
    "target": TARGET,
    "discretion": DISCRETION,
    "recon": RECON,
    "ideology": IDEOLOGY_COVER,
    "courier": r"кур(?:[ь'’]?є|ьер|ер)|розвід|развед",
    "media": r"(?:фото|відео|видео|зніми|сними|сфоткай|засними|кадр|зйомк|съемк)",
    "vehicle": r"(?:авто|машин|бус|номер|піксель|пиксель|(?:^|[^\p{L}\p{N}])(?:хрест|крест)[а-яіїєё]*(?:[^\p{L}\p{N}]|$)|тачк)",
    "vehicle_any": r"(?:авто|машин|бус|номер|піксель|пиксель|хрест|крест|тачк)",
    "sabotage": r"(?:підпал|поджог|розпалювач|розжиг|подожги|сожги|коктейл|релейн|шаф|диверс)",
    "protected": r"(?:військов|воєнкомат|военкомат|військкомат|тцк|зсу|всу|ппо|пво|блокпост|в/ч|релейн|підстанц|трансформатор|тэц|гес|радар|критичн[а-яіїє]*\s+інфраструктур)",
    "polite": r"(?:чи\s+(?:не\s+)?(?:могли\s+б|можете|можеш)|могли\s+б\s+ви|could\s+you|can\s+you|would\s+you|please)",
    "tied": r"(?:військов|воєнком|тцк|зсу|всу|релейн|диверс|координат)",
    "messenger": r"(?:телеграм|telegram|t\.me|вайбер|viber|wa\.me|whatsapp|чат-бот|телег[а-яіїєё]*)",
    "escrow": r"(?:безпечна\s+угода|безопасная\s+сделка|получить|отримати|зачислени|оплат[а-яіїєё]*\s+товар|списан[а-яіїєё]*\s+кошт|служб[а-яіїєё]*\s+доставк|курьерск[а-яіїєё]*\s+доставк)",
    "credential": r"(?:cvv|cvc|парол|смс|код|баланс|термін\s+дії|срок\s+действия|номер\s+карт)",
    "credential_hint": r"cvv|cvc|срок\s+действия|термін\s+дії|номер\s+карт|парол|смс",
    "credential_any": r"(?:cvv|cvc|код|парол|смс|sms|password|passcode|otp|баланс|balance|термін\s+дії|срок\s+действия|номер\s+карт)",
}
GRADED = ["reward", "action", "target", "discretion"]
FIXED_WEIGHTS = {"vehicle": 0.85, "media": 0.90, "sabotage": 0.95, "messenger": 0.85, "escrow": 0.90, "credential": 0.95}

# Tests of the latest message that settle the tri-state credential evidence.
MENTIONS_CREDENTIAL = r"(?:[cс]vv|[cс]v[cс]|(?:^|[^a-z0-9_])pin(?:[^a-z0-9_]|$)|код|парол|password|passcode|(?:^|[^a-z0-9_])otp(?:[^a-z0-9_]|$)|баланс|balance|реквізит|ключ|фраз|phrase|security\s+code)"
CREDENTIAL_ADVICE = r"(?:не\s+(?:надсилайте|повідомляйте|передавайте|вводьте|надавайте|сообщайте|отправляйте|передавайте)|never\s+(?:send|share|provide)|do\s+not\s+(?:send|share|provide))"
SELF_SERVICE = r"перевір[а-яіїє]*\s+баланс\s+самостійно|я\s+сам[^.!?\n]{0,60}(?:банку|bank)[^.!?\n]{0,60}не\s+передаватиму\s+код"
COMPLETED_CHECK = r"(?:перевірено|підтверджено|проверен[ао]?|подтвержден[ао]?|(?:^|[^a-z0-9_])(?:verified|confirmed)(?:[^a-z0-9_]|$))"
