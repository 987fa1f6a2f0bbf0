"""SHA-256 of the canonical form of entire licence texts, from /usr/share/common-licenses and the licence files of packages.

A licence has more than one where titles, addresses or appendices differ between published copies.
"""

DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": [
        "22d30010779648c6943c76d78abf372cd865d3b085c490f47072354cc7dd61c7",
        "5171b8b854cc05d5fb5f4bf96e3d3a512ebeaf1cca7823bd01b76c7575cca3e1",
        "65b0f68c514949c962fd2109fe3df5781ff4b306ffd0c293b4b6d2bd90bfca0d",
        "86a8373e12866ed7dd028f6f738cb2dc2a7a3e33f44445ffedb0fa7c518e5e58",
        "91c6dd6a9df0c7f005bb0535befcab541a3380e6041f701dd3626959199d71ad",
        "e0eace9092a8acc91b3f7f345f7f0508eb02414733b41af4bc88820e6f2cee86",
        "f3888435037482fae24800a2a7474293961651ccd29b2f83951215b86eeff9dc",
    ],
    "Artistic-1.0": [
        "66e644aafc5ff1de25be918be7e71d1d851bab015f750bc67c5b245e5f33ff39",
    ],
    "BSD-2-Clause": [
        "032f33a9fad178d38ba062bc5f6e47fde5eb48f13d4c8895fe1360e806c83a69",
        "054b7db06cdac6905b0508d20941fae9bf5f05b506c1447ca27425bb4092578e",
        "0cf81b3c5aff944fa45f579e56d005527fcda154582512954cd1110af3bf24f4",
        "0ff478a9a9085866fc8f7d2100f52f11615e889faeb55b3283a901c0f26e1d87",
        "117fa84a7ffb2cb3a2ba7d18dd284e7283b034d6fb6c6419721ee4e28b5306fe",
        "1717ff2b1e6acb44b4bb425448cac8096179fd05f0d9ea5a622a60d9409d56fb",
        "1a346ec500e0e2a3b0635130743cb752397c1ab0a453dea1a45bea5bc6eaa44a",
        "1b232163aba6859ee27244e088bf26bda1ebe96a1a7566e6b155e8bb2bd4c177",
        "1bb3e3272731f1886b0d067740e41826a4e410f0576cb09938e505df2ee3d8c9",
        "1d9bf53e362cd41e62a1d922d2efde16a95fc52b7f8a3be9bf871b5cabc6fb45",
        "1e519f8916dca74c89371617f4339d40a4ed3bb71e801c14aa72e8071bafaf81",
        "218f5b650f149e23f159537f8b1ab16d0ff44722e0038a34bb90a58b3442864a",
        "239190ee903aca2851ccd5099cd7954d026d60f9b9f98e391ca652499c6aaae1",
        "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2",
        "2745cc0a63b844cf79449cfeb9dbecb681f38d964a1341225821c2b2e836d0d0",
        "2aee172cae964500d9b285ac7fad8f76fb58d340d672cb1eee8d4203773bc998",
        "3227274d2bb2ca9041bd8c696129742c546f6eae6667ac09b20df18b7a5affaa",
        "33903615089fdb3ab02696d1bd92eb9580c2c7a0e0c8714aa95b0dfc1dcdb89c",
        "3851d34d50dcbb9256e3af58b5c99e83430619b6380f4adc9b118e7abf80bce6",
        "39a218d326b053017477f11ba35cee9d26fdac59f5656824e14e35aad6ac5ace",
        "3ec45d43611bee88aed2c5bdfa1e1ed75dedb185398832051e8a45b81d375bbd",
        "40c90f6c9238d3566db0815d918a429881073d60e82c7bec1eb0155a8913d98c",
        "4154dea462a6e4759be1b83221c481ee117d9435fd9c8400c651acea7e12e204",
        "4383e33424fc6aa46640f80aec019015d6f40e9da46cef735cb4c8a917c63da1",
        "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2",
        "50e39399b2949e392a28762cf2e32f31453a654e4e89aba87cde41f0a31fdb99",
        "5151319f99abfc15f9a1aab05c799faf3b0e5715fac5a5812b9d3566ae984374",
        "58c7da1fa6fd472a2f22f6a62c8f55019aa70a5b6507bac96dc9efbe99326619",
        "5b8ef1c1a86008deb8370ff91f82a060f4f2038a2a4c3ebefb56a2e9bd71ad91",
        "6091119410d6d441128c7514a97969723030816ec99a6b3939b6c4dfbe349d7e",
        "62de15399b91fa5f11e8036f11fc3ceb63e2ca0d3aeaed76be3818398f0ca6d1",
        "63151a500234e07ef3e50814b0d1d07db92c9481191003b577fbf42336ed40a0",
        "68f54bd97d77aa7c6d7a3706ff20555e202ff9393a9e5eaf4f0ebede2ff51a1f",
        "69cdbd21a2d990e706160e435568bdf1c22727c4ed2cab0cfaa1b78b3904ced3",
        "6a5d49c15e02e9e94957d78177d86e8631be9a19549a7cfd2e8c3be2699f00b9",
        "6b5d123c4e3497cba88844d845ccce94cdc9289a67dc4f061541c717d83fd85c",
        "6cc862c1f361bc6eecca63caf3b4ec6670825d4917e73700c8557ea444b19e48",
        "6e7a812c94c21565e57090a9d12200f36dbcf7537bf22ee860a7c3bc8a112122",
        "754bc1ec9f626d073526a7079f66dd38cd91ff4ea3b8766a05f32a698f64d9e7",
        "759fbc88d1a61bf63640c42d23a213634de667f3d7ae64bc844d566a6cb7dd57",
        "7acc61f0bd7743a1042c6d3379cd94a4a424b18f97fc7b342a2253b92e8082dc",
        "7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2",
        "7c37d31c659b5b27892d66ad6ef68598af2a48bca290f0a9a650944f5cb9128b",
        "7e45f8f79ca20d9ea38c96d66f315822c707f6ef57e552e9baeac43d60aa3e81",
        "7f95da13444a9a910b4f7fefbd81c8a1a6b59124899aa16d19d9ca717bb5e26d",
        "848d8414baba42cee479fa71ffa22ef9ec4b39f478316a6c872197c6a55e1412",
        "85b4e5f84a49be2c956e295ef3eb7be6d41833526b71640c432e94bc4157f8b7",
        "85c46767b6234227cebe127f5c22b9ede02ee48dda5f148ccefe8432c4d93221",
        "8b719d5dd6589c2eca021359760d89e7419885e6abfc6bd6dcefd840675cf625",
        "8c578795c7eaefda33b03bcd1b5617be4f3266067b6f02a35de87c3951efe8e2",
        "8e9dce55587c09da7adb0f3cfc5a8497b73e26aad978f536499fc078a7f8892c",
        "8f9b1d7f98cc07c5f9831c155bec1f0ce249018cb8372a4ccba2a31b7e7647c8",
        "9306d9b1b4eeeda99068499b65b760526bff407deb95315df14630d3c5883b93",
        "957c3854a3d72e069e7f5e48857ad9ab76135f14c70d60fa9ec6ef9a928d45dd",
        "982589ab4ef486a958cd7491482ccd8c49f9642dbec1ec15dc8c42fb34e1be4f",
        "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74",
        "9c47a682ef64c4e02c50c208384916c7f80087d4e4395b2b06e65a4c4b08b152",
        "a106c0e2bce141ab44a2b175cf75bea1cd380748fec8474f93621867ef092fea",
        "a11471bc40750a21bd4508891b5626642657a09eaa0ef1ec576be7d37fe5ada8",
        "a22a1b1fd2de7816d322e7e5704778af52b1861158deb8a3cc441af54046dc0f",
        "a3bead76df5f8284d9483fa7a384911998a49713991c5ccdbb01b854c54e33a3",
        "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30",
        "a915c0cb44b89d5aa65196f782a049c1dde5300ab02830c6939616406d8925ab",
        "b02d799e391838a73a0ccc75692ba88eafccab18abbd5f907e855d22048655d4",
        "b27ae1244cfe7ac22545c64d69df9d6f21fefc643e67fffab979dcb62c1df56b",
        "b49bd0d6098cc66fcc02220bf87514a0c322f58767634e0d8a68123653fb38d5",
        "b9578a124b7f83b06b28da656e009d5188b5c664c402b7c018c56cfaeb24b00a",
        "bc1e385eb5d19c6613b84fb0a516cbaef80caefb192cf62a0c520c07f0fcab07",
        "c0337f4d7b3d2534dd8c4cb1a8da7ae9a2175f0762806f16280e068db335e28e",
        "ce4f857e309d0c127ba303aa24cf408c9495660c6a52f3d7e245cd7ed052d2a2",
        "d312ae38a6144b61292dec4e639eaf71e5310323a42e0f9c1a31873645eb156c",
        "d7857e6e10520dd08f492ed937fc0036b8029d3410e390e58f7e30f726ed1b28",
        "de57375c814e70e786248ba1fceb30162dda44f473a4d05d2bc673d0bb2dccd3",
        "e36c57c376f1fac8945922863988e22c5e7460394aeb78fafeceef531dac4870",
        "e74f02edf06350e22d771b60d0580c53e28783fd12eda06abd03dab1348bc9d9",
        "e90608a663ae638023eb95a6ae359f7b6b865e6237fa832c48500c4e1af035b9",
        "ea8020f7414e77e9f71517ab4ea256ff1763e1dbc53d4e41bcf6b8f0f941548f",
        "eda2ad636e738f6a26a2fea902bb734ee48c789a5b40035b8db3659bd951e5bc",
        "eddcfdfb771f61c172f95c7ecd254d9c71d0a17a25bd31d82a815e6dfed10825",
        "ef3c818b28792f48774a4d16b461004c5e21338f9f74f2664f41f86803c30d60",
        "f12994e03bd5c0c39a53247b091a1066818635f9b776c60626bcfae4babf953f",
        "f4befedc01589c90d5effeae5f64453726c8fded8e4b6fe6c36f99d303581f1f",
        "f660a20fd170fe8b6282213c3411227a553f1451ee95bd49ed6ca3abe7045314",
        "f9c0de945db946a0b06e8587a80b1b35b3f3e48a0f63cb64860eb4e433d32c7b",
    ],
    "BSD-3-Clause": [
        "007fde9b266f35183b511c8c01994581175bfdaa48438967e905c31fb50ba523",
        "07002ede2e559c6e97a5ba89a53d7ded83eda46c54cea64eb39745675c2aabfc",
        "0fd715971b9eef40682d457e9b18f9eb0bdde1b640847b28593e4094f8871915",
        "1238550805feaeec7ac6f60c2a1b7b3828c3fb1e9d9d52c718c3b75c7b5ff98e",
        "214aa9c28152d6d77e6bebfb4a7511e677f65fdaf94b0fe9c0bb580e0eaf8997",
        "326c317935b3409d9750fd4ad5326ce15c9b75d313b4baf2cb9ff54accf8d903",
        "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9",
        "51d772108bb6e4c0a1d4b6c34089b05ba86e1c6f34ba03f49dc5d2e99acc7b8c",
        "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa",
        "5a6e7ec0b1ac1e224277a8a6d5cd7691ea38298b0308b87a7a2e539d020ed1e0",
        "6f5031a260c81332a40e090d5e58e0f0f98977842cb006396c5a55f924874540",
        "6f922c6cb2a22faa1c3d9be59103bf5dc2942321f1c76cc3b6f0772aa184826c",
        "73a15ef51d0f74bce7fc4d1287b8d8a639c37581de7f63863957aea115dca7da",
        "85a253fdca75357d8f16143d242204d0c291650df54bf470a94c229f0d848c65",
        "91ac11f4f00a65b8efdaf9acd840fb61dee7a83cdbd51b27a0939b4188201497",
        "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2",
        "9f656e5df280f94cdedf147e3429fddf854bc7bdab0aaa1cc17d4701303177b3",
        "ca7907d36e102a9283309374bec9fd25d45bf72d9d4ad6e3f882c8520e4e3318",
        "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15",
        "ceb36b0173297578925e297a5e163a7f0f988327f28c8eb9654153d4354b2598",
        "cf77ee3d20f4076cecdb58fc53aa7204c9f5c0651621abbc85e028f5b2ffa6b4",
        "da336ff5d6bbb6a30ad59a0dd798c7e6e1e57d719bbb6300725786c3648c658d",
        "e612af111b0f62aac3e107973cd804ade8a118ba3c7034d6824ebdce9852ba2e",
        "eabe215ff5a2cf5b1c090915b7cabdf511f70fc79fb8fde85247ebe3038a9658",
        "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af",
    ],
    "CC0-1.0": [
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ],
    "GFDL-1.2": [
        "244ff0df4332e65de1602feb52bcdfb2b5fa12f0153c0e44e103d1c50e57689d",
    ],
    "GFDL-1.3": [
        "14f37d0779b148fe66ddbbdeedd31e9bd07aa22676fc5218b61511459ff50398",
    ],
    "GPL-1.0": [
        "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6",
    ],
    "GPL-2.0": [
        "398e21dd76e4a6f996de3c1987000d368566d3d5c9654dfe179e5072e7fd6848",
        "ceb13cdc7143ca5f58fb64136b9b542b00470d4db4dbcee1328c6250bf845b08",
    ],
    "GPL-3.0": [
        "321a17a638214e99fb54bb10e7e5fc1a3ce9fdde560d27f8d2530657a9aea9e2",
        "9b99d369e6e67d3abdd48838023a32fef891116c5fc62ef82f7e98779c2d922d",
    ],
    "ISC": [
        "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a",
        "23651ce8a73abaa8fad9143faad3fca843b5de6baf345008f65c453ea5685fb1",
        "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db",
        "77e9889024ef4c09ad3e65c9c303459fdde03c84e2f9d24ba9d7cebb938ff23a",
        "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee",
    ],
    "LGPL-2.0": [
        "cc8e7fa9f9cf8315fef32bddbc9aa00edea19a8d4cc8a8b79af8595808ca4b16",
    ],
    "LGPL-2.1": [
        "38b2435f8cf1a11a2bdcba9a05f347cf9063612b86eec3d468355f817be85a84",
    ],
    "LGPL-3.0": [
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ],
    "MIT": [
        "00a5c934b705d69594539c6a37a1105192217249a30fe111a375560a492639c9",
        "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c",
        "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164",
        "6733127d88b7d3bd59c42da120690dbdff1e658acf3fa3e2448092079ad6999a",
        "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f",
        "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127",
        "7c3366b22b9f0d6a198b2c29bd1c4b663b2d55eacbd066146e5476c4b8ff1ce4",
        "8cde46b543036122641d289a848d3900df55f9efa471b2ff7354da3a6e4a113d",
        "95d6e15f26b09973979cc939f067e143dab922c3ae8273ea44b568d429da0660",
        "9803b59d0b48bc4c33519eaf3d6e133d08c752f8f17a5cd3d6198abdf08e49c4",
        "e6efdc968de004456b25b55c6664804c4cf6c1a284deb105868631cebb22f3d2",
        "fb691d28b64b2a306b30449f04b63780c13263eccc568cc65d7f25fe9748dba2",
    ],
    "MPL-1.1": [
        "c3754fa3290eda10675f5ccbdf2525e4717acc479d73ef03524ab7e393bab08c",
    ],
    "MPL-2.0": [
        "0a9e3d32a7f24bf01d16516a5abfba9b19d53f60aef0a720705e0580ea38d942",
    ],
    "Unlicense": [
        "788cc8843bf483eb3ea3b5f6c317b95502da6e7105963f7c57c872ceb263fd49",
    ],
}
