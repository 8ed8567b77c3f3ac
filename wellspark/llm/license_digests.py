"""SHA-256 digests of the canonical forms of public licences' entire texts and of one-line notices.

Made with ``licenses.canonical``: it and its spellings must not change without making these anew.
"""

ENTIRE = {
    "Apache-2.0": (
        "1ace1b495067c0417a0eb8336c3fbb62187cff9f17f870951d41faa5eeb5b215",
        "1d2490e65bade4b7cde700178105759a1eeb6ed401841c01b9ff35e40e55c5ad",
        "4ff1c9ad58c908969c501ec5ff7eb680b56bc20afac264b52117bbd09c921e1f",
        "594673f8fe0542761280c31fa6f0d1eca9f491e533af6c2c1fef40b1c4229b47",
        "bb9623a3f15021216105e0ed4e2426d8ef8863d7c5f58860ef1cd2bf983015cf",
        "cc411e5c73676ae13e68bf0fe2c031a62b3a1ef56829577a7d168699686c1e7e",
        "e9dbf930ca0f1e090ec68da9a37b657d11bc9e43b30643455d6a96dbf73116ca",
        "f16a2c71cdef52763eb4e8d07430ba72c05356a4e2204a12f3995c1ee5d38fde",
        "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100",
    ),
    "BSD-2-Clause": (
        "01eb06ba79d40ddc0dd08e54ea0533bed1c78bb3e63dca15dd71342e48a84a72",
        "02c1f81d33446b0add9e5afc1d1f17ed9c8ac5fd8d60a10b2d9033cd60720361",
        "0e25203e22fbc5b8269b012b1fdcd2fd09fc577deb1f2c6c3e4baccb49436915",
        "0ff478a9a9085866fc8f7d2100f52f11615e889faeb55b3283a901c0f26e1d87",
        "10677e704f35e9d68ab40192dc9035db9a743691d71ad0f39d1ae44a81d27e98",
        "107f8ba0af742645bf7864695e36616fbcaa19b8c1ebb01f30fac7dd4011913a",
        "115ad30982769e86a03d5b7cc86db1fae9a9724c68911bd2562ea2f385b841e5",
        "117fa84a7ffb2cb3a2ba7d18dd284e7283b034d6fb6c6419721ee4e28b5306fe",
        "18a4ded338bbc2e1519cd794de3c17e3d5fe9628e240824c584fecdebe777a72",
        "1cd2d4d633195ae0e7223a94a138f2ffeb48b5c1e6cbc2bd997dfae4cd96abd6",
        "1d1a3f907ac2b8e243bdf9c51f92b3a187160678cb8f29c2a3ad0df897afe642",
        "1d5ec6b24c5439f092c1777bef5f062494697d22e92a253e56c520a87913b541",
        "1e519f8916dca74c89371617f4339d40a4ed3bb71e801c14aa72e8071bafaf81",
        "218f5b650f149e23f159537f8b1ab16d0ff44722e0038a34bb90a58b3442864a",
        "239190ee903aca2851ccd5099cd7954d026d60f9b9f98e391ca652499c6aaae1",
        "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2",
        "2aee172cae964500d9b285ac7fad8f76fb58d340d672cb1eee8d4203773bc998",
        "2bf55e1ee3fec4b4db4be9c854ff5ec0813ee9a78fcec8b4fb32e65cc80514fc",
        "2c570d136b858b0a4d090e301862eacb53fb1ae2743462bf3b89e602191665f7",
        "2ca9b831569502f7a564db02c1c455629e3d0cf50a3aba854deb0aeae56ff5bc",
        "2e9901df2d3cdd9b2ad2d0541a98d0ffe16ec6a54494b7837b493c08b3bde071",
        "3227274d2bb2ca9041bd8c696129742c546f6eae6667ac09b20df18b7a5affaa",
        "33903615089fdb3ab02696d1bd92eb9580c2c7a0e0c8714aa95b0dfc1dcdb89c",
        "33b183a3f00b28db2c851f584380147301f1808f1ce373889663cf3fc5f4c6c2",
        "3938f828c79910468f483f925e6a33217162693f71035d6044cbd04dc6fd1bd5",
        "3ec45d43611bee88aed2c5bdfa1e1ed75dedb185398832051e8a45b81d375bbd",
        "4038c3ccd5fa8753677529584c619d7c444b612a24f5b11ee38c5af912766141",
        "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2",
        "4a5b45ed3ca9ae854c5505a774b3659d3852be9a3412b822802b3cdbe5dc7b0a",
        "4b12427c919036fc08e3d3d6bda2d2d0fed58212d4c5dfc57237af4a66887098",
        "4de7c5063149ddc3df97ac908c4b301dfa1c3dd06b589e7d2780dd939f15f916",
        "4ede70430bf3b227c2dfb5d047a5c3491e9c45d1f525491374ce169d89856024",
        "5151319f99abfc15f9a1aab05c799faf3b0e5715fac5a5812b9d3566ae984374",
        "52dfc149fb90a79ca6183476ae71a9f5819c8453066e985e81763616357236a3",
        "58c7da1fa6fd472a2f22f6a62c8f55019aa70a5b6507bac96dc9efbe99326619",
        "5c1bc40d4cf560a21bd670ed48fc79b694511b770b651a1f3de99d492f7976f0",
        "5d123f3d2076a6b22f7b17a92623627ef50d1584e8cf13b7d4040f1c6e8a0424",
        "6091119410d6d441128c7514a97969723030816ec99a6b3939b6c4dfbe349d7e",
        "63151a500234e07ef3e50814b0d1d07db92c9481191003b577fbf42336ed40a0",
        "68f54bd97d77aa7c6d7a3706ff20555e202ff9393a9e5eaf4f0ebede2ff51a1f",
        "695e2a30013b39c36d82479b111921a72908a563d6218a720fddad199d01c28d",
        "6a5d49c15e02e9e94957d78177d86e8631be9a19549a7cfd2e8c3be2699f00b9",
        "6b311f1f82b5f7b5a0cc379e40c1da2c2edd9f71c6f479c30628d8b9b27ea691",
        "712dce7d673ff7e1550976bfd879c441ad93a2d9906c3c4ae27441d29fa3350b",
        "759fbc88d1a61bf63640c42d23a213634de667f3d7ae64bc844d566a6cb7dd57",
        "7acc61f0bd7743a1042c6d3379cd94a4a424b18f97fc7b342a2253b92e8082dc",
        "7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2",
        "7e45f8f79ca20d9ea38c96d66f315822c707f6ef57e552e9baeac43d60aa3e81",
        "80ad0421f0f534e8c876be108e2a472cb774f475ac18f2dd5de5f5777a632ddf",
        "8487e44d35585f42e9392b2b5d09ef792ab09e2919a18cbd2abb381f9200b0e6",
        "848d8414baba42cee479fa71ffa22ef9ec4b39f478316a6c872197c6a55e1412",
        "85c46767b6234227cebe127f5c22b9ede02ee48dda5f148ccefe8432c4d93221",
        "8906363799dbe7a6aff07f665d7698ad3e34b029f09df3d473bf1118a17a2f1f",
        "8b28f63734bf310903015ecd26ae5c979f31743ca170703b95426d7203774453",
        "8b719d5dd6589c2eca021359760d89e7419885e6abfc6bd6dcefd840675cf625",
        "8e9dce55587c09da7adb0f3cfc5a8497b73e26aad978f536499fc078a7f8892c",
        "90d48255144eaa2455264d0af9ef20ac2d4b728bc2fa878ea3059038a0bba60b",
        "957c3854a3d72e069e7f5e48857ad9ab76135f14c70d60fa9ec6ef9a928d45dd",
        "95c73627cc387ec5d01a1a283ff61cfc383ee2f6a6674a9cd32bb6bab5523cef",
        "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74",
        "9c47a682ef64c4e02c50c208384916c7f80087d4e4395b2b06e65a4c4b08b152",
        "a11471bc40750a21bd4508891b5626642657a09eaa0ef1ec576be7d37fe5ada8",
        "a15fcc0daac5f45ce67b8232a31ffb9da0dd18505ef702a3726b8d923d9971e9",
        "a22bda8212fa50035126e431ac41c79cd005e4b384080ea34eea71a7962c411a",
        "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30",
        "a78184b2c67ed3906485a7e9161d724c95e04261082e06a27869e1753384b18c",
        "ac9ef06ed60437e7011df1bb3d6d2271e208250a7c75f08f344f125a7b560e31",
        "aef99695204288c3828a4d0acd9e62a735a6c1781beaa3aee4aeb504f1f112db",
        "b02d799e391838a73a0ccc75692ba88eafccab18abbd5f907e855d22048655d4",
        "b27ae1244cfe7ac22545c64d69df9d6f21fefc643e67fffab979dcb62c1df56b",
        "b49e3171ad65b058b8bf3e883f871733105dda273652f037326a902dfbd40178",
        "b5335fc56cb06fb488859427303188fdccfe901752d74938dbb3e63c952746a4",
        "b7a2aed1fa065cd606a9a031c76bbda14762c5ee42dc79ffd671ad56ff168604",
        "b7d49d651647319f38c254df78d020e1c773cbac121d97b17eb70bf3149e7233",
        "b9578a124b7f83b06b28da656e009d5188b5c664c402b7c018c56cfaeb24b00a",
        "bf4cd629bb8a70e349537e8ca530dc88576938ec375a2ede8054a0ebaf7ae836",
        "c5cb44b340dfa97436d18371e401686dddf3451388afa1a24c0e410cd7a38b24",
        "c6530869092e0b7cfb394a3f66ecb00a61f8ec2ab8d3eed56dcd440740355b34",
        "c77f71387fff2ec44a9e786a87447ecf27f78eeb0a45258048a2f81d23e310c1",
        "c8dfdaf03e5088f3bf1cc5707b510462631176f9b17c1795303b38ceb4dc1fde",
        "cb19805eac283bd8cea786373cc0e19cabbf15bc4cbd572dc1efb3dbd05ca91d",
        "ccaf7b3ed3b26a1ea677f8501b06ac3d573183033fec83ba7190ba7fc9902e2f",
        "ce4f857e309d0c127ba303aa24cf408c9495660c6a52f3d7e245cd7ed052d2a2",
        "d69394be0a847fe521c89264bf2e8cf6ecfd61bb44868747d2184929f1ddf3b9",
        "d8273d18414549823077df21707b29ce7fb0661f8dd82fdb4b3632c3d07901fe",
        "d9360b475bb35dc9bce111eec4d3be1faa67ed2a3a561f03ad44e73b4993919a",
        "df93f02f99d4992b996886a219c3b82d40a5629010e93cf447820f349f77d358",
        "e90608a663ae638023eb95a6ae359f7b6b865e6237fa832c48500c4e1af035b9",
        "e9a0102f47a1df080263249009047de6a23629449f8a4322101f0f823d624879",
        "ea9c4edd200327688edf2bc6e017904cb1f8b7b184c1c5312e418a819491b558",
        "eda2ad636e738f6a26a2fea902bb734ee48c789a5b40035b8db3659bd951e5bc",
        "ef3c818b28792f48774a4d16b461004c5e21338f9f74f2664f41f86803c30d60",
        "ef7bb3509c4d67461d24a16e5c9bda1e22c2dd0fee97c3fde7e16e861b33cd98",
        "f4befedc01589c90d5effeae5f64453726c8fded8e4b6fe6c36f99d303581f1f",
        "f660a20fd170fe8b6282213c3411227a553f1451ee95bd49ed6ca3abe7045314",
        "f70e318812c2186c966e06dbe61de79ef179650c6b6b0763f3571effcefd5ab9",
        "f998580832297c54404b07f284b5f1e3a3f47de6af9fa42bbdbf7cf453ae8043",
        "f9c0de945db946a0b06e8587a80b1b35b3f3e48a0f63cb64860eb4e433d32c7b",
        "fa267b21b941fa3a12202db43de930c59e9af469dd6610a3c916546baf9f42e6",
        "fb99f9c35500c071a9fb216cf951e023b13b20354051dc781de1ffcec2dac248",
    ),
    "BSD-3-Clause": (
        "007fde9b266f35183b511c8c01994581175bfdaa48438967e905c31fb50ba523",
        "0088eb6b9add0e62876c655c3479b6ea7a621e15f5c0accfd8df38afd4ea40e2",
        "010e969ec1b4f0b9dbed6c739853573e773dd79a6ea1a57475d7577ec0e015f4",
        "01db9685465efc9a2afbcac2bac2e45ff7ff2f863e6d89d8fdab898374e6aa71",
        "02cbb88221e507a296bab4438d8c41fc55a45c1e486982b72971ef667bab440e",
        "05a65b8c78ed817dbf0e23d8ba6bbe22400ded67063b4df496b1316d93c69ef1",
        "062d3d2ff463d28ce353f94003f7b695f4b02033174e4674f1bf29aca6a4c138",
        "06e4b371c615a6b49ca48e67122a483cba2238d11a2a01de4945f68f23618bea",
        "07002ede2e559c6e97a5ba89a53d7ded83eda46c54cea64eb39745675c2aabfc",
        "08736309e21ef4f4f04fe8d65d940170f6dead365ae956175f9f925b68835df1",
        "0a6614b271dc744e5bf9bc48a15881a49dfca32f391b53668e97952e752f1bcd",
        "0a693a9b0f9f456ac1a8ead8338f14410fa65b203bbad63be901a84d32b36eaf",
        "0d9569accbee32dd3a420896d10f915d23071d627b49ca2f194661b3fa6aa139",
        "0fbd7c43c4bb3e398d262b8e39f58ee0a8709a2b3b6b4bee4e033b3d5755f58d",
        "109f433fa6d7ddc201aa2bf2527bac4f38143cdcf2ea093dfa07d89074bec856",
        "1157d7738c8e4b9714da26c13a27d402141a7cfc68c80f72c30fe25698134732",
        "1238550805feaeec7ac6f60c2a1b7b3828c3fb1e9d9d52c718c3b75c7b5ff98e",
        "13bd4956c077751ad193b5da48b859c64ed6922c7c2b69a588be360696d979c1",
        "15b03ef135fda7bdc026f239555d663d1b16473622b88f9d3e513e1cfe9a4ecb",
        "162537e34c6214aef31257756ea7a4ab5da6e66501fa71992fd77a9200816951",
        "17bbb60c28cb61b5ab8955b8a5e3d27094b0fc17f7591820a1f6a1dc63b89daa",
        "19c2166d95c6ce0c8779953e0ed36a837c49f83641540452badc9e2c15ad4461",
        "1b8e40ae96131e1bfb010d2bfd387a0c40126f751453fc4292a98ab0e6433f24",
        "1b9c2fc92ea32d1c705d689163d6e1783efd910af0262514c4185cad11fefe75",
        "1be9f950747887c6b820235c7e4a394f3551fbc740487f0dcfb3c6777863b2cc",
        "1cfde29875bbb5fc143b11b8e6f47e316d751885c03826ca160ec8ab2ea24c70",
        "1df9653bc861bd2d04debc888c7520b12f8069da758fe64b63338ed87412a59f",
        "1ff3b3240bfd8d2489ef0dbe1e93c248a1ea92c6753dd367dd21dab256a80e21",
        "2197427e156dd704210ae726a3807f7deae35bc31d7243168c575348f6a5419b",
        "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
        "220781d65cabba526c5f2c828bc0b2be5176762067699c3a6a1d990c34e288e7",
        "23108758e2e92d798e2eed8493094b3215976176dd57a4a5fd2c6186b24fd1af",
        "25e8b4ca173574a7bc7b23a01c7a7b4f50b15e06f5adf5cf8a44de3752bc4516",
        "27684044cea8daea6bfde661f96d5e94f477d8edc783da33f0cfcc1eb870c3d5",
        "2862502b8c0b9e2898bddc193550da25efbe12dcc633cf5c250c8acd75d2fcfc",
        "288b16dd057d359a81060ebda0feda90773042673f2755ed83de86dba322bba8",
        "28d8c51fd19fe9d509b189d89cbd23e3f49a3733c7ebf18f437d1a348eac3026",
        "296acd24c904e4c225ea4e20a155685e6c06e3148585be52164bd4dbeee4a1d9",
        "2a2af4fe0a0c9e8dc0f8df538b0df789d036fb47c3c60b1f493cc8dbd0720505",
        "2cd789223d2baedaa30bd977afea0acaf45d9776babc8ec34fb68933864f4c40",
        "2cdd19f933f323a30eebbe32aec8e6b66920a61bb8015563b953e080ecd5fb6c",
        "2ce555d5d2083dd52344ef444fee875197d4d780942030522ce6b94f3b989285",
        "2e4072217bf8d26c98aaadc7a50f70d1f9d08d0e02ec70764015fe85fd18599d",
        "30f8fc34b2278a2ad2925ee78a439987efacae3b4e91586dac719ed740668843",
        "311ffd640fdffeb73e7bcf8a56eb2a35ed732f8f4c2e62b7e5535aee04ed1bfc",
        "326c317935b3409d9750fd4ad5326ce15c9b75d313b4baf2cb9ff54accf8d903",
        "33342a9db7fa431da49dceab85a0cc7cf9807f2477c3e5ac5b14eda68d582853",
        "33512bc1af4d9489f7408d3510324a8001aabccd277956747a080461c97522cf",
        "351deb7f721eb7c3154c21578f5fc0da71afdc266f1b1695a77ddb86d2f8ccf4",
        "352ec8683763764a59c1181e23db1a61def3894d6a1e026bd93552aa3f54ba93",
        "3565ba72a31a4b2f64df7f838e49fbae6ab5685c50a0c733ad78b980b49789be",
        "379421399da056c123b65762ce0292191fbba43da8ee754262479e18d83b23bd",
        "381a1597c60970e78836bb7d9da99e690f5a6664751fe19cd5447f6bce238970",
        "39bc19d2e32c4824fe446a931672e4ee8ceee7bf191f76bf6c99140b01c64550",
        "3a56a470abdf91e966565ca80736bf977b10b9b64c519ff49b55262b52fdbf0b",
        "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9",
        "3d3aa00cd4c03ba994d65a6afb82e790c85e8004bf260cdac9044933d97c2dfc",
        "3e393d2a20f3af7a4e329646961b888b8448864699ddcc92e14f1280e8273925",
        "3ea4450d5fe00f243f0c4bb7b8408b3f65cbc01dd1efb43bf037b5a392e8bf9d",
        "3f60f0cdf78f0a92c80fac67aa6cd8641363b5b786d18f78a1122a6db9a6b96b",
        "4079d1a9108ca437dd29ac26e1f73dbf7bb3b61ba3392438373db7018cf188c3",
        "418027c022345ec370b1c9271eb22b5c5f6670ba86ef8ef468346b0236ff635c",
        "41ae92cf86b077fa7aa037af7258499be24a3e8fd634db251a147e1fd8d49da6",
        "41e953a81b97d4d49d183543aff2c7f31e7bffc9548893292f14e70a9bb876f1",
        "4241a91ed59fdc8d1c20d065984925429610744add02cce3becf94e4e83c49f9",
        "43b1bcf7769e68b80558cc96ddf01a0357ebe5f47be98b4015acd5d39621d681",
        "44593277f32002578dc7b7dd9fb2c040ad1bb03d3f3e9a990822e02c07b16ea1",
        "4639944e0b3fc2b7a9e0230545e2cc6710f6a5c096c11b947aa56158a5770596",
        "46799f15b76137b52727335ee9084a9c75b2898459107e3dd27593929fcd4b0f",
        "47781a8c4386f5672b7501ab54a3f1c79fa2f73a1ea35b84695a65a1af0896ed",
        "491f49d0415b993dc6768897df5e7883078940c54392a8dbf118987091d73c49",
        "493007603f0253126a011d6ffcc8904a4ad632111f51506fe9dcd54ec01b1bb1",
        "496a88fb77f7cf55994de8bd2b87ac0e9302e2dc1b11f567dd0447f8f0648ab1",
        "4af3efd27cc12d2146661de254afc90bde9fc2c708eddbfe69013f2c8cf24654",
        "4bdc4e1cec04e5387f957e15b4e9897485ceb8d5553e1222f04e3758c87251ad",
        "4bfb244e03bb8ff80f6efb1a78cded6cfd77aefc484bcea2baaf4096ac8e1f60",
        "4d4c7991eec13c8481fd08902fee35e8a6cb959c727b7aa5dc0c4ce6bbb9c6a3",
        "4dfcca916e71c9299212a9fc9861195071e773cfac7726b6843e229a0478ebc5",
        "4f8c431c971d670e355968be484975c70966ada9d41a7e0d22ae7202524f37cd",
        "4fec7901c0764f1c632da504aa28d5de5e7e5f0783c88d1e3fd21de4f97e315d",
        "50a52e525bbbad18027648f0544c1dd2bc68264eb5e968d6584aae1c35716535",
        "51217464054513d69ac6654b877b23cd1bd0ede566a5316ae2c0c42f63b5762a",
        "51d772108bb6e4c0a1d4b6c34089b05ba86e1c6f34ba03f49dc5d2e99acc7b8c",
        "52488cdfc29bfa2ef46ddfd827785f0ad9e9fd9759af5bebe456aba62c7f867d",
        "52708ae7496bad323efc341f2b977f4deecc250729644235974381dbffa10b45",
        "52c8e1f1387429e4ac2e46a159e2b2d17320de20b05dce03cbd7a7cf9be73702",
        "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa",
        "531150816f8187bbfa93916bccdd581f0752f125c97e3a25de85795de14a6a7c",
        "54a11abe42208b3ea52a7682e9597e365d3170c949afe123c4a0ea6fd698cfe1",
        "55ed7373378ee85b7d733e107d35a4b7820dc39e41039276746db8325860b756",
        "566414393171255b64d311606c5bdb34afaacdcb147d1ee12aef747968128f7c",
        "5787dbd3df382df7472e10d16f6756443147e46d8040bc8c1cb5a8fe0c011be4",
        "584a6aefeadf84d442ee9defec05c326cb9a3d0b509b1d6b498681902ff66281",
        "58553ade7532181c78fbc000f83db782f9cc955f1a3aefd48b5a405c173555a9",
        "598a67411ed0f51ebe0e82984ca16b4bdc02f9f6373f41d0ba5cc8c3d9f6bd00",
        "5a2a789d3e539c6419b99449d506cdb442ff86f4bc70a376a2dbf45467861f83",
        "5b425c7def920919df8ee92a47fd3fdd131c5a31d01b1f550700681b8af315f1",
        "5c40f1edf73983ee70a7cb30c11ddc042552bc3b86e5d14760dbbc4116323ebb",
        "5cbede8ebaa14f3c21025882f1c98c60d712a39c5454ec6d5da5f4f9ff2ba2bb",
        "5e1ecd488a751b906a60c3a8a118848440c2b9de21f254acc7a7bad0d8cea70f",
        "5e2359d6755f00915fa126c5891f037ab46089eddd612d6ab02393b682103f7b",
        "60f2f6ba1d2895b1cdbedbb82f220ba09c824563bfdc6f02893d8aa22b39d68c",
        "6165d601148ffa6ffe3adca8f8c84f6a5af0acd8c7216218c3adf186dc1c8903",
        "61f881e48d73cb5b978745907a04718c3c556201c71b325ec60d63970ed54274",
        "627188ca76d6479b5e3de67549019ece8d741cbce6668b051be6f8fb4c605a08",
        "62b48fb59edb4c184ad621e9466f9c3c3ac935e8d6538546551188f831fb06b0",
        "62fc31cf517b2c28554757d0e106bd7a05bb6d00e865403371e471f629301ebd",
        "62ff049ade6adfe5f65149fc9f9f620782030396f9581b144b111b394a23bad2",
        "63af53fd1fbf09af6ac254fa47b5e7a58be0108be793d5b3a7cea78be0afda1a",
        "66fe8b89df56a720b2be7d5906e63b24cf4d27908cb172c0f76c1f91e9c57abe",
        "69083549410d2f63af7724cabe9383c3da756a9875b71a13bdf06f218d41d7cc",
        "69fcedb70fd1930cb5d773bb71eb605a3aec6362c678302194666d60ca468f71",
        "6c04b5ba14baabb47f84448f7fee193f4030d8628ca2f755a9ed49d6c3a27b0f",
        "6cded2d64ede823606e0ad912d43ef7cf641160926310fa31217c3749fa32aee",
        "6d8a2d69220d800f01359d3b257543798365c5cb2f56b2f023b3a26d0e1d45de",
        "6e5ff3a5e17bf78bc2302e3f5b9d296c357ef3a5760035e625deb6e953d1e58b",
        "6e636cc21b1ef1a5a79ac9b4c43b18da62350e54cca2ed05b4bc31361d7a9eb3",
        "6f5031a260c81332a40e090d5e58e0f0f98977842cb006396c5a55f924874540",
        "6f9457ac3a104e46e85fda0a317d60092f7643f4db9a711552b9979630165c81",
        "6fc618780b44cdca4b29e5e2df831e67dfee9bade4a4996c59b815c2bfdb566c",
        "7094cb4f28f384ceecb02be6774053999f4265ce14f9b09a11357586e81036f6",
        "70e29a5acb29bc1a91295cfe0532eed880b869282421182fac73309f47dc34c9",
        "70f92f35862f27c95a390cf57675d409d26cad237a81d89d1e4fd53bb8588730",
        "71c22a2d0b27990657a3afeeb55a4d5339bdd339f5b7a14e0a973ac3e329a14b",
        "71cf08b8c05578254c14bb399fc5a7858151620fb4deaebb8570c6b11f37f3a3",
        "7236a925b4417b0a38ce9f48f8806f09a35615fb3acc065fb248c8e96553d770",
        "734c53b66b7214ba9433f9e0ae4ceb8d797c62547655f5fb4fd640109dbb1571",
        "73a15ef51d0f74bce7fc4d1287b8d8a639c37581de7f63863957aea115dca7da",
        "7668aff13b074ee8ff72fe4d1e7a5866b755b8fc00cd0239e4e80aec12f32127",
        "76b173bb2a6492f7941f15493bc75af0a3afc02b9cde5cdc0cad10b180455932",
        "7824adeed84ed4bb5971cca978b508d57ea2b81cff77927d80e7059517b4098c",
        "7877a8b3a09019f70351944ad7f5cf0b07f11d5d422dcaa4c1e25331b490364f",
        "78a5d7b57217bee04ab086125fdaf448f35fcb1db4eaf0a6cafaa88c68d8591e",
        "78b4e5f7ae33786641902252e1133eb757db5f5fe08e9371907ffbb6272d3aa1",
        "78bc60ad3b19f3f03be6f4865a4cc2f9d0d1a95f8608482b4670210e08b79387",
        "793740d7d3fd9b9d9922ac2e7e49aad03e20274b63036ea46facceb598e42494",
        "7aea53c0d7a37e67b5b48bc0173358fa13cce6248e39e0f781aa1f29758b4c03",
        "7aeeeae04683ca2146c56bd853a6dc04ba697e70531fd43f1b6923042fd1d204",
        "7b3d31be6c146cd9333d28a51513235c2fcc35fddff3eb68853e448c76aa40ea",
        "7b57614be5d1abd5826bb4b7096a1d2f91fdc92e36f49112bf162ea0ced57045",
        "7bb8b2caa06bb496626e26d3bd70986bb79a9d29ee9580b5663c72ef01331c39",
        "7bf5713ca296b08ea88a5ab4dc815cb078bc97d56fec2034952bc7d8ba65b4dd",
        "7c16b387b2fd67aea7403110df9457eea9844b938eda62df5f98a56797001ccf",
        "7c767f194fe83a647c60b692acb0d747155ff3c4c52b85acf0599e0687b9b29d",
        "7cd749a629e1ddf50c0e4c507338eecb902c7f13fe0e93f05f6795aafda2c85f",
        "7df5f9053e4e1faee2ee7abef000d0de2de4632c3163f2f547a92d9d8cd84e92",
        "7e7382b6461a6f92161aff0b8651e636ed5d14e0d63eeb92333bcf38ada81f90",
        "7ec67c1aa22bf9221163093efa667a005137e688cefa68bd4128aa970f140143",
        "7ece7f0e69edd8d55556d4c507e6352508936af22315e7ea15e0e0aa90c22f53",
        "8078ca96ff592b24ba127e14c7f110f54057dcde2c6023deb34983ec3e23196c",
        "810a3f256aa11298214ea81ae78b16b99b45d83fa23fd7bfaf059ab914b0fbd1",
        "833a95d3106c89080403e4983e1d87621d03a88cc0209363850bd02493f70d2e",
        "83d69db61501ff577eb07497268f910880a2bbd8c9b9ca5768929ae8632da58b",
        "84af7d67dfc08e461b6df2faca398ff03f9eb63da659e5a5b9de1ecb508da146",
        "85a253fdca75357d8f16143d242204d0c291650df54bf470a94c229f0d848c65",
        "85e5a114819fd686fe0378e4d01afee6d871515717f20d38cecb4e116896bc4b",
        "88b15678873be432c85a65aba7f6e3c7e1be78e34de2f53f78c3e18d9e589b7e",
        "89d4664d70db90af1136963ecf9080988ff70c2fb999feceb3d75480dc3fc8ac",
        "8a69b3ae3c37b6cf9ce330b5e5e3050e29100621d05ba8c828ff817e2e6556ef",
        "8ade638323b06be3951b2c6a8ac27489a02d9bce0b9baa223586a0136cc01098",
        "8ba6133c391f099f3936e999218e881ea570d37c2b504821ed3199d4b5421c47",
        "8c43033e30638dbf655a64e3b9cb5ad496739e3265cd1173bf9de626f4c07b0d",
        "8c9c3329a1c6b55bcbe9834033f4e4ee29d42c4e4bd7fba729c7a32494c607cf",
        "8d3ca0373e28daf90fd19456545db29fd6ab2817f5bbb6f80818d50de181d626",
        "8d41715a4d6ae31ed0993d0c3721a4753a2d78736b102347458b0bfe885df89b",
        "8e6a00da3b41501414630318cd39ab4b24a7f05ff2efaef3b6ad87f3b1745747",
        "8e91832f5113b01123532939083d7f591a6657e86d73f1a588000091473ca645",
        "8ebafa9f4fa1847e8777d6f184f256492897bcb1d4c126d998c2c1171c2c7a6e",
        "8ec96ac102a1a4e8a51586c5069c7bbf5b233cd4fd6c2e01ef2e376f9fbace63",
        "90d6679ae0a8915f632a522be3860985e6205a9488e629682f7b07ae5554e55d",
        "9112544a284feb6fc4cd8e50541d3a9e2856ccfa29e7e66d376dbdde72933121",
        "92784a4e0c9136689e30e1e962fafcacf62763a36fc6fc2b8af05fd978094511",
        "9484375a11bc8ea97e4c598ef0b9e816b4c869d19081d2cc07e454457c50da8a",
        "94a0a44b170114affb7b3975c6987906dca819b6cbd93510aa70be57345a1e3f",
        "94aed4b9f35cab1c0d08c17b1bc44b488fb4360e6998782287b7ea6834f1a6c5",
        "95091ba478be7d2a2b5291f2ac4fedfb8f95643475eaad0abae1c54452ad4e11",
        "96064c6ca672ab3190383fbdbaa98491ed058c95b63540b7e9c2a8aff6da96a0",
        "963afa54a725b4a13b0e421a6ea9c46dc879c500c7119063c9e90fc74495d2a1",
        "97976edb98cd1563de99edd0a720f00451b383a5f428afa8b2d59626a2b76226",
        "9b5bde93ed1ed368fc62d2b900fd91fe501186419841d78935aa23b00065e7ef",
        "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2",
        "9b9ac51f5ca1f4f99ccf94a0770c77723a9b4a5eaf09e0de3f8c9ec65b1f396d",
        "9c07b35bff4c7723f05498d5016671e6aab167812efed57d22d711c2877f486b",
        "9cd680d56db42f3a510ba3089570ba3abf28066291ae57ecf32e4d67e6527310",
        "9f0362afb460d3e8bff2aacf4d8ae58168308d08e7d33d026924bccdc7b5a3fd",
        "a0315cdf233260d0968fe03561ccc66382df84d2c5e3ba7bbc801593358cf4ae",
        "a1b219564f74c286b8e6d513ce628a398682d68f7ebee4316d742d704938f7dd",
        "a205bcec3679f22931cc0fc9845fd6bd7e26f5f60f196a41ed2686495c36a704",
        "a2873b453183add3e99dd4198a65a1e0ff9944a934623fba2891c17994e7da8b",
        "a3951516b8108a3be505e781b3e3d0afe4837a24414f94ce88e1a2fe6144babe",
        "a41e25204ce120d16472a9dbecaa89b58562c3a76aaf8c93fb614d2e15abf9ef",
        "a42d1c0cd12e1f0d3644f3fb06a49be2ae4d9be26013a5716184fc9f4609f2a1",
        "a4db61d91a7c7b170648a2e4781787e4a2f6b2920570b86654f00f3938d8176d",
        "a5715b13c711391b4f68c39d784c5786cd7a28247b340f1f3e2670c432cece8a",
        "a5a967f1089352270e4c31843b08f4a8cb5615200b01391336132c121e184d3e",
        "a65aa119a9ae25139c00daa069f0ba1397cbaf52bc0cb15bce536c93c866827a",
        "a772d5818791ac44ca752b2f36a65bd691fb6827311afedbcb995bbfc44c149c",
        "a7ff60bc3d3e063a70c4b5db4e4045b2a1839179e223284b0f1c64a4ecb17840",
        "a9387e8ef58f7adf41d686fe6099d7d8081a442198d313756d6f3cbafa9b2bb4",
        "a9661bea8e8887912762354e26d499412f664f61dcce2e0116ffa41e94cf64e9",
        "a98dcf53df2bd8167b86d686bd31e35ec3ce68b6547752821db35a456f3ad5bb",
        "a99320c0c43ec177925f51e30548b38e6a815148c1c8cb6769c08a888562a7ac",
        "aa866e316323cea7da1d89161805deb29ad6d6deb8389ecab8623f397e0222f7",
        "ab0736a881e2cfbd69cb3ccf227f784a4d7a75b2978e086d1e989e2dacbb9135",
        "ab5430620be02482629d50015c53290eb90e4020039cd97fc360ed52e41a1d87",
        "ac86fb005f6d582261a5079ce3594d2b5e13aca2b0b2ba7573dd330c5bae70d4",
        "aca589ed7c9d4b8172070dead14e6c903a68d0f4486b8573d6bf693c8bee32b4",
        "ae30285c241e4d6f115ab40823f970c4328fb3c7601f32a7ebd261f477f9ae17",
        "ae872f2ddca8c876f9bc566dde22da928be4ee41977d423bbe0cdfa17395bad6",
        "aeeb3898cc82d179c178e8ee2a845b6dfaa1105980bb8cd91529e070557242a4",
        "aff44d9f03d145272cb59e063b396ac9a551dcde6719d47a519325add9919133",
        "b160ddfe2d686a08db1250286870065be48bd2bd67908cc2ba729309540fc400",
        "b1bd678a334b74de9cd11cd48b4a0aee575c41952fdf830bae4d6aadd8b08ffd",
        "b6ab7953b6c80a72261014244324a70663f1807fa212f52461b24c95eb16b4a9",
        "ba78ed9fd03730d71d3a6bd2fce9fa8318dccdd2bcef97294525377acef720ba",
        "bd7d910c4d2db198970b03aa0712c2453834c2245727445d4d1552208efbd9be",
        "becf3e12ae5631fa4df14a61373d08358cfb61301543abeee15732cd20c60fb0",
        "bede4aa57fdf1d7c676c2f22fa0839432b3d423dc298ef754f1720b9cb9fc6a6",
        "c19e45e4caf36d04a07032e4291ae19dfa1ba7a438b4d073c576d8271eb7dbd1",
        "c20bd9e9a48d3165b5e500f6c32225194e99d15723430c8466d4b6390aeb0488",
        "c3c37a3f2460d1e6b986324f6532d2e7c13d17671d91e5ccbf8b24d2caa2a3db",
        "c461eafdbdc6af57a0dbf3f8ed35c31b6a416f34945b19490cf59ddfc274ae20",
        "c544350f03f72e209c4f5dc6de5a67e442377ced3da16530054b3a4ad387ac82",
        "c5e3da532699e38cf476422d333a1294d3c4ea9636bab723d6d2ae7ab6e275ba",
        "c6a9818755c3e1e0944061752b7d5bd58cd9b0e0338253b19ad20ca48a0a34f5",
        "c7ca75170b39649889cf7ada8ff2127791586dfcdcde1e89557d78580163705a",
        "c86d75bd19f935ac6c644509e3159cdd3a6b0519968c41dc09d8aa09542a9ffa",
        "c923f0176bf43797c3b86a4a75851a9ea679c9901d7d88632e82b59903e8c632",
        "ca799e073f3e5e2ad4c06cf7dd1e32c2807290c6ca0fddb7096a95815626bd44",
        "cacf49127fde97f977608f75ea188b7e12f9fc3918c0b8c6093b9dc3b70fc428",
        "caf994a964c23bce4eae6836faed999b5e4d89cfdceedda8cec093bcb72efca5",
        "cc3432eb2f19bb6fe96706bad75b6fce1039db64fb70486899bf6425dea4d9cb",
        "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15",
        "cd6f54f8043eb2e58f20b56997704b853109085563d84d6313b655b2804be685",
        "ceb539a14a135648f303dbe38b2f990c43786bd70c95bbbfa427010d5444ec1f",
        "cf4ce8e62865e260c5d329058a0659e185aaf266f693f6a3146649e17e99de64",
        "cf77ee3d20f4076cecdb58fc53aa7204c9f5c0651621abbc85e028f5b2ffa6b4",
        "cfefbe7aec2ef93a76da4fae3c5ad0371fe8d66599bfc6235874061c0a46e228",
        "cff43785e1f6c2f9914dc63db46a2cb86ab62c7d60df5af8cf5b99fdbe53dba5",
        "d0a339eb5454123c6a1f2696aace557e0561866f3fe33b93ffad58ecfcab7060",
        "d12241aca92b2cedfd52f87769186998da68f551982c913c79863eb6c63e47f2",
        "d3c826e703903409a9872986b9be88801a6c28027cb8f1a0bda16d9c3bdbf96d",
        "d4542b2c750ddc48ef799c19992beedb965469683f3ad3c4ecfee120fcf832c5",
        "d501c9c83cfb8c5cf5edd7e75ce27b6a9d1725ebc3dd329f1e7c3911fe48d5da",
        "d6257db4781e8531fee85c1cd8fe8adf06a6b7763ed73da1906a14d24925fc1d",
        "d733eb1931d9e2960267b45810ef8de1bc818be61bf5803e7b772e9b731c36ef",
        "d82109ca031904db888330a0ab8c8987685e71f8dbff7393792df6d32b4ae712",
        "d909d66f1d054232d3a4e7e20422b25eab668d5fd71c0df084323915917cc316",
        "da336ff5d6bbb6a30ad59a0dd798c7e6e1e57d719bbb6300725786c3648c658d",
        "da4ef29ad2b72e87dfb232418f89799e96070bae83bab194c479fb81577c5362",
        "dabdbdcb25e5432de092766dfc0f247a3cf5e5f05bbe52cadeee2cd33cf171b9",
        "db493d43eb799fc9a0d232338f9158a2dbf8fe2cbf2a986bf8ec9364fd459611",
        "dbdfde7fe53358e4d135fcf0485ffc425b2b94f13f57afa9728bfb29ad9c40e5",
        "dc06088169d82bfb3bf20fa94566038849b41f0c772ebdf6cc13a92263873a65",
        "dd2487115e67eb34b54e9da4a368a7202dcf7d055a877c7a0f17a6fb6d6dfd19",
        "dd9c572087f92a74232343008a70468eeee08d97112450db549eb0fb33a8d29e",
        "de4e07da7243c131e709fc246ea2fbc87ec7980416912854f273d8f9303a425d",
        "de5453ee1c529e411dfc07f5f9986fd5c976127d366d655c521320e9af85c28f",
        "de6addbdde1d1ab194f29eec0a0af964ddaeddda64f6ea91d030ef3a3bb6deb2",
        "dec1b2f1d6d6951a6cef23b4db1468a7a3c5e4d8273eea033dabf170a585d4a8",
        "e0a2092139c370f402284efaf452317f36b6cf859e5aadc058eb21b6e63bebeb",
        "e159b06e31fa849a5200c8e0d2bbd990a73a2ce95f88209b8564e6a424f7715d",
        "e1fe76c9b4f25e0673fd17fa7e126e4f3496bb89be3544fa06c914c9e20ff0d2",
        "e327b35e2b01d84b108447cf1bd62958a3a0431b96631ab4f225c0b10e274f1f",
        "e3822b78899a2504578fe674211d3f79a3a343cbef19383842c4a3d1defbe0c6",
        "e438bb0e276847e7a6ecdb85799124eb746d2c95dc2310349ed8cbe1384882af",
        "e60143686f94bbff438ca8d1ec28b93f48dab068c458d943110c425586e89f38",
        "e612af111b0f62aac3e107973cd804ade8a118ba3c7034d6824ebdce9852ba2e",
        "e651765ec94c99c2ea03cf19aceb85785d656ba08685eb0772747c296340cb54",
        "e6c0f196ed7d6d4199b81d635f0dcd65adcc0706606d33fe4b158237aaed30eb",
        "e7e4fb63adbcac46bad9c18e3c6baa663738c178b7651bd3dc45515b3fa0ae9c",
        "e86913ff42ce9f2dd6871a6f20f633e23b7db03f766136aa52163c9cc94baa76",
        "eabe215ff5a2cf5b1c090915b7cabdf511f70fc79fb8fde85247ebe3038a9658",
        "eacab7b84207c1b4a2dedbff0a5a71e5f4eca0be6e53b59de71f562ea4f4d06a",
        "eba25c920ebc89a341dcbe90d79a9b187642283bfc026f8d9e9b3bfdc72d8bd0",
        "ebae317e6ae0f1391a1b4f0b90badec871d75e6a7dc118873d0a505fe1760412",
        "ec2379829cfe784f1d1a6a07924cd45a533b72af8f570ef54deed276599f705e",
        "ec363c23a099b8a0f4289098d0cd988f5487ae2547888d9445253c8e1fefceb4",
        "eca1b24459dfb3fe09e91b0690ada723fec1dd5636a163c8f112d967b5147b9d",
        "ecf52a1a19a2cdafa19bab8760f3bbba89ff982c03032f015aad96d9c73c4209",
        "ed0104d130ef02966836b3c8fb16c58ca9a91d49ed78ed3281531b463296f124",
        "f032b2f9ad7ac1bba875e180d1bcb9641ef3e523dd4280a960ab2d95b275ed6b",
        "f063f73dc21fb50e9c071f6ea652a2f67276a340d385eb359c818bd4a817359c",
        "f1e800b458673bf7d1b7fa6c81e42e10c7897eb3fa57834fae7c8da13b302d09",
        "f2784c16508eb5ebce419ee46ab03b8eac1d3d3d9c9dc425bc6d2c92b98d74b6",
        "f2f49b468edc6b1259a03d37c9635c3525e11ce7388ab69d63d77cf3755741f2",
        "f30fc1e9e0ba46bbe109dbfed88179dafd7c29f5eb2acf2d44b12e4f36b5c481",
        "f5e8212bdbf0465a5196123ad9b72a89f88bba7071a03c91b20f6ca41def6fd6",
        "f8fd13a02eae8e3ff714b8913784e2c1309e9753dd0b6b50eb750d71e1acc729",
        "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af",
        "fa8eee52cef33c5c1c90a2d4abcc1967d0decd02989a8714e04c9bfeaca3cb29",
        "fbeba36b4c19ff4a85738ee084a1b651a5d6086b7158a6f2d8ef7fee909a6113",
        "fc4fb33ab76235de8e9f690230f0bcf5076ed6d319bf7e355fac01a359f8271e",
        "fc9d58c8af07b9a6ba35f540ddd88c2047588738f644216a3e7682344718beb9",
        "fcb1a0c380058f809b25ca0554186822cecbeb28b5371f0da772f68c251ff826",
        "fcfaca9856c9d06723391332be070f14157dc455699d40c8852a50b70f45fada",
        "fd12fe7a476142533f7a2cc6ae0f12ed30bf2f661027b73ae69bc05118c1bac8",
        "fd6f933ea400df745b007217b1fe081c0915d890b3376cb976c145afa4da433a",
        "fe6d93c1924e715d2762b6363b22bcf84bf77677d4938e19cb0b7688a4c236df",
        "ff5b40f7806001889524854b876dcf3a8ad16eece1e6589cf59e2faea72c5e91",
    ),
    "CC0-1.0": (
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ),
    "GFDL-1.2": (
        "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f",
        "f06741c6c5feec30d99f80228f0d9ea6b884eae0e790ab18a0f4257184befa86",
    ),
    "GFDL-1.3": (
        "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4",
        "80229e90e6f40a551a447f33ef48bd361a8e3166d53f29a2d1537245e2064feb",
    ),
    "GPL-1.0": (
        "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
        "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70",
        "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    ),
    "GPL-2.0": (
        "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017",
        "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1",
        "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999",
    ),
    "GPL-3.0": (
        "010ce52b3b970c80b5447205f4afc3b42084811cda2d11b95178b1fd3940764f",
        "3d4de016a08e1d98b27dec755cdf4530b92807d97aaa185b32e12d52942b1943",
        "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b",
        "f3ab5ee40da170411ea6671f9845ada2aaba303ee57ba6086b373d1e66c9dc3f",
    ),
    "LGPL-2.0": (
        "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3",
        "e0de5033b5ad2a24c0a1a8b04f09e33038ffa62d2bef7178de2a3c6f5d56f499",
        "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c",
    ),
    "LGPL-2.1": (
        "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c",
        "9bf9c99aeafbdbccd7456a00d574699e3deb41868375496cacbf170be719bebd",
        "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345",
    ),
    "LGPL-3.0": (
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ),
    "MPL-1.1": (
        "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6",
        "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354",
    ),
    "MPL-2.0": (
        "3dacd2c104719e7227969cbdcc7d581518827199e830b9379627eec0a32f8ab7",
        "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
    ),
}

NOTICES = {
    "0BSD": (
        "c80b41accce841a950f62682d2c5b4eba26382d32b19220e0a0e73c67a4ee505",
    ),
    "AGPL-3.0": (
        "00b599ce12b27147b41f0982e5c653a1b090315c53b91d09840992b638276cfb",
        "03d9307c71683ea521d0330ba311fef43bc001661b0882d8039729ef25f70d7a",
        "05bf8a20daf5cc16735d5f1f65296db0e28e209a8069499b2e251359449c8a23",
        "0aa1709b95bc989c8f228539e58a41d59c782ac6aef6787229d2f4cb3f4d40b7",
        "10ae9677d5c01a1e97bed6a0eef9a959ca3a75b1c12636da9134a529de930c47",
        "1229f75db9ac5cfced7ab4b9d87da84bcb2a31f711465615fbd51d45ccc89158",
        "152c499f0675410aad006c54bb3e6b5c1a270c8af6718058ca504b002f130d41",
        "16d940d39afe3ab0cdd56b343efa0508a9e9ed0620a192e09c5569c3fcb3865b",
        "16e7897593337b022be2858fa8d11f88497e773f0789b3cd7d0e4f13a38eed77",
        "1d1552521bbaa186c2fe50a694a8afe49c483cf7937e63c31f1798dfaac3ae53",
        "1d5a8de23887c7b5e853c6d559fc1842478fbb891072e3910d3e559ea19ebb47",
        "1da208f5e3025dd0af4bc75f62fee739777f37c4f1798a9d15e210e1838c8126",
        "1e287942b134ad4a2bc96ceed9e6b588d84e9bd5b8d7725eb4441acdefa8465d",
        "1ff24a3fa27c2cdedd0c34aa34d9f651133775f90ec59d88add131ca36578fa5",
        "239b7b96057669616020319c116fa983eacd357d80fb25f41cf3a61224318925",
        "23ddf0ff4c69e97cd017d699e7658bf06d3114f9931a78ea970ee7d489fb692b",
        "2b849e4c6d4ec233eac4b4066d6b43dc9b2debe716c178fd2519595119e65821",
        "2dc8e80bf63714d15fb0c4ab215f192c0ca716b87c94e88d5068e9a92943dbc5",
        "2fd58ad763bc07c777c00d20a1996fa2b87370dea2317490f9181c1516eb2579",
        "329ad8de390a0c3d1b5e9e4fff2e89a575adb0afaf6f7b45744c6010f352c775",
        "370b252c5eccd8deafa7a488f175e46b86dbe73010a4f6fb10c79bd7a5a17711",
        "3f31a6085134782508b46e3d74f0d5e0fc5e170bd958b57d491638e4926770c0",
        "3f8559d775384914cae0da000f97542905726b01a74a4319e69576b2113510fb",
        "40016a4d4e0da938df56be82638156df71fe1b2bb530d4b4844efd96cf281106",
        "4474e2dd5b0b3545b0ce7d741b1d229f385a490d3a8b0d480ecfe55cd00a9bcc",
        "4873faaa130c2913c54b4fecaf7c2c4f67d6fadd59a8ebb94ab97a5ec9d4f723",
        "4a2118d89fb5f5f4d80884ca786ff3637ca9032104d681436f8e11fd39faae5f",
        "4d236b8b019175c3737b91f50944f3bcc99aba225e787d682f57d4f802a77855",
        "4fff3cd546845e665357d858f056bd0732743cb9d56c66b188f367e4709ad687",
        "5484d12aba769b5dff0aac155e52ae6a36e6b119655609d48830441fb9e9dcec",
        "569235d86a4c7a24324aaa774c20f4c33e16fae53f4b78c5fc5f82190c091097",
        "5840db6e52d82e40d710206acdaa43f060d67db5eacc455df1bc788abcbf0007",
        "5941a7ee2bbb30e8868cdb9d7eca8911e22d77f063f9db77ed270899d4997705",
        "5c33b07a2e3ab3faaf9a6740135ed5f58135476b50e0d6e0d08c543ebc1ead1d",
        "5e3027414f24bcc2c13728e99dd0203533c3620214062dbb0d4b2fbd543a9ffd",
        "5f2915061b9bb7891da12d07e6b69c1e0948cf06c046ab44bb93e8ebc6b49f7f",
        "671186d43c638beae5f63fb5b334cc963b59fa4075378e9332f57be633c1ada5",
        "67eac53bc3cd76fbca3e53e5bc01581ba4e09c48af66dba5d568a200e0aa6c83",
        "6a1ce048484d8e9d33694dd91e4bf111effbc66d417b3bda0f4fa344efd0caca",
        "710dab4f20bb0e26cac7b18facea4d84b5ce39331868145666ef15d9ad51ee00",
        "72ccf766d47206d74710ce27a9d41a3cfb372164cc3e67991ca6d066916b6e7f",
        "7884510a8bae64950a419bc36a4f77a243b89b9aff2b1f124498c48cbfcf1712",
        "7c295927e42305c1f1628fbb9890ac8896793531b83d45595f2f54c8d2c773ca",
        "7f7aa1ddf62f0f879d6b48846bf8a43187fbf4b6dffb815c76391b20407233f3",
        "82f6b9205e8c77bd70cce17f355665eb2a784c7d20a013bfa8925d8ffa2f0241",
        "8796f0c20431302093a4f2c622284af69083706f51bc38ccbf12302b8b4f69c1",
        "87b820bdb962081ad57c22b3d54ad57fbaacc1f7614b93642194aca2d045bc6f",
        "9148adaa1901e35440a275fda0068a7564d453049e0584b30c3c9275309fd736",
        "914a58dc24385b9509139c1477b162c2448cfec39b238ce26a6d9c17cc6e3602",
        "93d4dec71d94e1c2491625d3a283678efe40c3db3cc3a16a43b15df915ce690a",
        "97ebb24d76f53a42aba080217d3f13bf7226e964fee00585f80a1295323f3ba8",
        "9806889ad4549bf94b944af606e955b6dd15d54fe8464909b6820bab42525ae2",
        "9bd1df28152f78121dfa0ee1d1b629e7d82d5447332c9386a64a706248b23d77",
        "9e4e5ee55753fe122023a2f75d5d79cb57e08f647f63e9465895dd366f6fb387",
        "ad5a3aafb1eb778814be6a394a4616857f37eb07cb1eb2556c52483a1edb86e4",
        "ad9c15d3ab8d718ce6c7c0dbb77c8a3e62f6dc0ee7e3dccb49168adc9046d8f7",
        "b37bb07929318a448a03bb61a5fba5a9e8bda99786a3e05bbb87824d70c67169",
        "b9d8cadd2aaf0d42a78764b0d598d703f0b0f58b42ff9b9a44a2ada4b8571df3",
        "baae7a929dbe57109911ad98a9443745bfdc89c313b29d81dfee1784d859c873",
        "c0b52b0f1962547d0a98fafcd9b3134508d96494515f2044cb5fe5d52f8e6358",
        "c22c577a07a2e1ed551f7a5475fdda3d86cefb8d9c1223fe4778592751393c27",
        "c464b3ac5eb63d39513959b55518e8cd76ab4c57c2928d81acc090c2d2f2703e",
        "c89d25e65e0cb375f27baa9e0b62dd34f8f67bc5b36bbd13fc2c503c8c403aac",
        "ca6288fba2ec2ec0b3ba5f7e17a396d0cde93b8bbfb07738e60c2a9d4adabd81",
        "cf697ad1eeee285c3c84e82cbce0b440c53bd772f660794668e81da6dbe9dc1d",
        "d210a13109c176ccb0a26e6e3b207f6ad3117d3072dd79426c6ca53cff9c1a39",
        "d3585bda4b0369839c9c903bdbec02722cf22e1790c8582f5a00acfd252d61bb",
        "d6bfe793ea84c92a2b1c3bf5777e1dbd16534c164554e75759c3cae909774f56",
        "d6ec95784d813941269b270bb1343d641f730093ff4afbba2ad4d642c53e7b3c",
        "d6fd77eca930cf7d184f98260bef7d99afd8f392746cc8a219bccc1108a57f02",
        "d9fb6f651d36cf131dad483647c6ba635ec7dfa04e74a40582483b9064e7081b",
        "da5b0e7cda11106d650997ab45851a51690c9f56ca38d42ad79a2a69afe42c62",
        "dd46ea08ec6bea20d069d9ec0c67c4a97a77cd4f11ba1320ac54360b31cef965",
        "dfe1355a644d38bbb5fd2c43654d1abde727599e4290b485411901c77c4c032d",
        "e3180d1929318d6ff3cfe752efb8a481fd487f98b5a5ee12e7cac6e9bf8b1a30",
        "e47cb459c20ad2814f831fd6f7b0f9304d45782014db626c75437bc7c90a09d3",
        "e4b606a790242a82c7b9789be2da2275b4a0a9372093de64f88e9bce11da0960",
        "e577197bfa7e27b1e2b21e20aeae06b59cdc6decd8fdb5d22a1c6b5feefa172d",
        "ef0350680c50baac13d2ec1a7eebe8ccb5ba37d4fb67383be97b178580bf1125",
        "f1ff0c787fa7138595078d825b41e53d5a93b026451ba089ec4f0573a4c733aa",
        "f7e9242d07ba84797baf4940b74f9036f84259463565a1554d2a5853308f3329",
        "fb89b35a28cb0b36999259a87058a5068470cac54856dec680564c17f3f028cf",
    ),
    "AGPL-3.0-only": (
        "fea60196413cd8271b7c13c7c03db0b70de1659746409f64e9890863ad3ddd91",
    ),
    "AGPL-3.0-or-later": (
        "ce6162fb462dac3af3a9f41ba330f20afd9e193d4030147c64ee35a730a22a7e",
    ),
    "Apache-2.0": (
        "0060cb8fde2a046a19d3490ca85c08fb1d92a10f8f13ddbc5f0a572e1ef148dd",
        "0312bd975dff7e2350a8875e02d421c811e2a00f690098a9e3f4bd52b092c20a",
        "051a04d76c8f6790c0029000279319474e31c2a16835e85cf7403ef2a4d02ea6",
        "06cbf369b88483e0054d7427fc538f1e1c516574efe3801a3fb65178cff4cf28",
        "07fee2d889982da2a290b9fadbda459d7414f9210efdcfa166e6df9548215caa",
        "0ade9accfa606b7b0c88548d7d30352d89598f361321dcdb7b7f1e09a77f1b4e",
        "0cc079d18e35c04bc1739aa08e586217df13dd44909f86866304afc4da970c8d",
        "1138a97c474da89ae32d87775ff20351e4020b2ce4d2e77a366c3e32f9c8c0e9",
        "129e61e2ce62aea4e623ea7239f42d6a1da06bac50042898abcf1b7915184fd5",
        "12e5ed9ec4df580a58c23cc9f7e73b6565942331e9c21168c94a72f9411e6815",
        "171fc0f88199a4ecd719615c3c64fee175dff97600aac29ed060e34e254bbfa5",
        "17387434f197e852334b060d11ef47aab7a8e5bc0993e7d95962a36105a60891",
        "1797230683df8b38dc79e561f1e70bc890fd9f5f6c7cd83793476730a6f35acc",
        "17eb63bcc832596db298360221227131eff15b4d1324e95cca4a1517d2bd52d2",
        "17f21927348c48d007e166a98a12201ec904b7bcf4cab833b3ecd96d8d633da9",
        "1a46e285f5d7924223a041adbb4cbf2f7a2a6f03570c06b02708f0322db348b0",
        "1ad20b52e2abb85332560085ff376b3ba6eb66b83fa72fa01a092c223b2931ff",
        "1eeb0cd6a418dc793a27061b17be61dbba3407cf36c633dfd509a0ba3cecffe0",
        "21912a6a88b09c1475af434396d7b076867ce195cca3b05980ca3703733d4bf4",
        "22bf46423bd90de71cb653f6611e37491c453ebb828d7e44affa285d675dfa9d",
        "245257ff6905c94de2b361c356a82edd7f7dd844f24fe7212a7330ecb83a626b",
        "2715bf8b4595b483c7ac6a1d46627336ce75da15633ca725b7cb607aa8f48740",
        "289313b481c0f431115d4f17afc300a6007a10bd120bfcab16f02ea99128002c",
        "29fef9cedad89f36a25b5f58a81d9a83d14454a2c35c2722b006c490786797e6",
        "2ce46e0451c1862836603e9c9b54be6c58727d5d639d04226de14526a512d4c6",
        "2f1cdf9ceb6641ed14c49d6e7eba48e7b6e03d43e5152212dcedcabb0b93f779",
        "30b5c3b7a09686824ded4828ee4a52bfe6e235b9770cfd4ad689522cb47f1021",
        "391ab96fe7bb5305bb0d2dda4d6e15bf2bfe904ebfb0c9adfa687a2f080139ea",
        "39f08831a8b50892b4de638466f26a8ee52264e83cc7042d63099429b154331f",
        "3c2cc46eff71e1b2479400ded13d68686e55a7f7a376d3a3c2360dcab270dca9",
        "4172e584267e8ce8afb1328608e04872600cd5a2a00e96f7c480f28964336b00",
        "431876b9a7e0622aca98046ff5c75644f68803bd730c8229fc25c7ed6d1bd165",
        "44fdcc1d2c007ca37f36ad304896ca6ba5342d0170d9a82a9d8f6ed3e6c92f85",
        "49115146196c23fb627c7f906f65e80c342e33188df8079c831b14d9123a5af2",
        "498a96f77ec6cf77d5b2d2f5cfbab5ba7a001d4e69eeb48433a8241d31f0ffdd",
        "49d80ad7f18e6dc15342d93b27d410b6c49671f851e01050af20bf48af7b684f",
        "4a2a552a76d15f18c6bda9525e12d71ffdbd59594117841825aab851a9f8dc2f",
        "4a715934b4fe59fbc2c3e0fea2de6ac212c93093e7512d3976b8c31d8d37e068",
        "501f4b8e626f4edefd67c18f75fe841500d4c2fd4a8f7a5b4081dde03fcfce13",
        "55c1e41673cec717dde03acada500adda089bdcd2f875855ad19afeb0d1f1c34",
        "58ea7ba772b342fa46e55ac2bb82e876b95f9867fc382de8c8eb509effd81cb4",
        "6c48e63f7919477b3f01c54f5b17268cc405321737e92d6e21994491d3adf81f",
        "70887b80da797920f2920de82e2f65ba16f707e6cccc85b84d5c69ca913ce6e8",
        "708cee96f92e05b3002d2cca49f0a2231bc2866b53374c4d81e822e43ddff1f2",
        "79fcf15dd0839303471961531ead5f34d8df3bf788417c03b7a8bbd179f9a531",
        "7a574dbec9b4471f0a4d20709f48b7f43561c989f17fad4c13c78ad14b040bb7",
        "7aeb946237bf537c9b18d52e2f83ccbac2e54f42dde7a67424c39f4f8b6f6b4e",
        "816e131d19d32c5f333c76ad1a4adee670a2633b7ee9cc5fae140a7acbd16b57",
        "8519c0f65c96f85f5e828660e86722ce1c032008c7991bc2298f72a7552b1dea",
        "8525d67e3e4f80063dcabe5ebb824ae9947e6c52cb0ba0d95121de2243e7f4e0",
        "85df94981f2ec90a4425cc8d3222facc0c08b10bd2a584d3a976cbcefc7e7c9b",
        "8e4ff0b88442a2b67fc201f9b3ea9f698a4d26f8f83468ead1f50e875acd2bf3",
        "902ddb3614c8ed7c86955aeb233c5a01ea1d518e52509c601ce5ce4379f12d56",
        "916168057401044e4b32f85d38ffabca0c0c13cbf7834eb89d93dc7686e26044",
        "964c265cb9d4635a68b48551dd3b891f8efdb4bf62c576db07e15e4eec8c6dfd",
        "98ece3fe38ceca789769a3c7dc73e000996ee38b5b6fe8655376189fcbce8d69",
        "9cf25cd9f0aa795171da3140ac0b4a6f066ba12e9c8656c37aa0a09d36473495",
        "a0060c476205906c8b35eee3a29eee51a5c444c41d795bde2addf42d0ea64de5",
        "a3b3fe910b1de7f8d5d4a72ebe6db0e71068e8d0bdcda677fbd03a1415c110b8",
        "aa8508b4999e352adbc9e94e2709888dd72bab2e0f89b7124331db4df91982c1",
        "ab3ed77eb34d7bb269cfa6080ee4081c468d63b4af3f075874cccf518f8ec451",
        "ae0d52505b98651b544af0feda124c44fa98db694859350e2872c883b775e0e6",
        "b78df73c44dd0a6f7eceb078a0cd9bbef5b26b5c41a84cf180221d425484be45",
        "b94dfa25bf189a089b1f5bafedfaec8ac50acdbf3aedae6fa0dafc82d6c746b9",
        "bae104773c9f4d1155cf9199fc44ef15621dd3a93c7f8c7d30687f8f0999cfa2",
        "bd10bae158708cb406883cb57272756a84b66c8581f6a12ef392f7e6668c788e",
        "c039f523c8c0aabfd7403d5c7f99ace606399206ae53e68ef818236cd7b0c58d",
        "c246883bccfe83f3496b0a2629b57bbf7dd56379659fddb41cdf49541c929b4b",
        "c9445a8f797e6cb4ff7dae6e82ae1f5b65c15f992ec3d3e5c3b1a029c494f5be",
        "ca459ca82a9e2b6247fc5f8fb943bd62d855def89ec1b22fc34af41f00559e7b",
        "cd97cbddcdc363376000276e26e90a9323d2a8d92c7bd14b46ac21c6b4ea0d31",
        "d0cf1c3e64d6d9229074ddcb0703384a5ab0279cd7f0b7e85b6c2b1aa918333c",
        "d377b5bfdd5bf4ce19edc59758316fe678a710a8e60bffc47c2d6761cbbf8e9d",
        "d4a91e70b39acd30e06ce75b2fc5b21710e206c15438f59f080440637fbdce70",
        "dca592e6f5ed68de604bf906a741668ae7de7165dc8a56964b98affe1f84cc0d",
        "df423e7c4f730fc2a42bedd7382f794b4aae357d7b413dc5213e9a9fb3c2aee9",
        "e39540d84d5e59d7da09b4751d25dbb2f406f692d98cd5694d29220d7637d7ab",
        "f509e9a18334f20ff4b03f36d4a1cc2f5683fa0f207121075c4cddc750cf275a",
        "f94f6a065bc2f0ca1b6fdbfae5bbfe0283c69b777ec4ce26f3206b2bcb570a5e",
        "fe1ae755653f40face2c2ecd1ca91512e666a9236febe294ef9bcdf45328836c",
    ),
    "Artistic-2.0": (
        "6369e2523528e2840c1a79143feabeda5240a53c4b8cd7cd29defad5354578a2",
    ),
    "BSD-2-Clause": (
        "04a25be3d9f90659b2879ac6a9089825f627b34612185cb628fd54fd73a209c8",
        "0767555a2f77264465e2d3daf21c2bacdc258becf3151df3ff26df36ad3a5bd6",
        "095e5226e9f3e63e2532685f53f0b9199180b4d2335e8e3529252fb16cbd196a",
        "14b4c19a7d9af831720a556376e5034285a008cead59ce241dd6bb4640e4b507",
        "189f9df53a44db03958f049bb32fd6030ebb54ed6b5828ed0ccbf4b5301ecf09",
        "19650bc40036ade9a07d11752d47d8a63ebffd6fb9a02cba26608694c37de139",
        "1a4ae7834f9770eddd4c6fbdd23f1c88a4260d75e0b3fa193e74ff2c8f2a86bd",
        "1f6904a0f51d8f116db5a0791303a17ed979172c0e9d532865d9baf4107d62ab",
        "21d3fdaa553cb021a79cc88d9726e9f77d44407aad6d6be2c2289d45412182f5",
        "28f430282c2d775254313278191e9b648e8a7d9bc683def0b532718d69f5e5a6",
        "2a1147d124ec7193338e95826d66b4e7d9c39dd9c068b34957a2637fd6529282",
        "2ccd071fb3dc5a847b1cd84373626f1a24a1373e873f69714ed8b987910a0f38",
        "2dd2dd8a3c6ff8cb819aaa98679b8f2e5f6ea7dcbbfa1914129adde478003b54",
        "300b37de58330d4b20dfc85b55c52a046cd9bb94e13df2d538b07db3bd65242d",
        "3356447e534c786bd7dadaa4ff0cf47d1d79750fdd421f00d2bd5610950369e0",
        "35300ba0a2c71a38685d1777f2d96e3034f0b204041d559165f35d4ba7109b5a",
        "360b2080b04aba968c07fdf5c77119633baa5acc6a305de940aef0b39f8081b3",
        "37c53d1c1674656f866ab8221d9ebca236275caa6068d41fc279345165ae3b5f",
        "3ab674f23b87dd70b404f87162992a7ce31c19757c23a80686b3eeb15b635b76",
        "430d6424a558fd007633fee91194f20f0c1d0b7a346c7eaca0d42eee4474e552",
        "4b42e0ad3fd664601393eb5c3bd2af434dce42f077b12a4340d72e75df3f1df8",
        "4e0569c6ceab7be8512632a15fcda52b3db64c6a6bc111701e80a6075eff7287",
        "4e8d57fd1080e218eb5dc288a95035c6a5f9a01b7b632c54019c16c62a35dac7",
        "4ee7cfb30997aac9686b29947113110170cf3ad8d9e6070fcc1aaf319f60f39a",
        "500afcd026615e8ce0fcb1cb866eb727345b52f12f782fce580e26a0071392c3",
        "5895386d9d6191ce0f45fb5ce3340ec8c5fc3e62a4b3908be1c8f0bc364d81a9",
        "58e7cc6e691ea158ab053b846e5a243836cb7ea415e01b5e328b500d90161817",
        "5a3e2462499476d9df2c54e07b4e52ea0e7c7732036e5d41e487b5c46a488138",
        "5ba6344583e3a9f0dce80a3607105370a78416fa87dab9d0f8184afa822e0b74",
        "5c53efc7365bc0c99e50748bbe895634c7cd4c26702300dcd0b6c77cedf862db",
        "5cceb2c0dede0c7d22c8e7dcbd03ed1ec6d286e7f54b4765083c689f36b0e463",
        "60354ecfa5fd5759e7424cd272fd25b91f21256a6e7ca7744adabe15c8e6574f",
        "6114e37b3d686acebc6b0142295bc1e85d5aec185528fd7c16325462a67ecce2",
        "63a8d44b0d50edba1ca97585321869a83e61fb46bcecc8b98f7f05ed4d09c760",
        "63b5609abe6bc4aa5155176ae6a743eb7978206d273f147cb409fffc9e7e4d54",
        "6a23d96b0b11d20b627f92d805b73f913a24c02682707bd1b0ddb0233210e545",
        "6e26285ce47819a69c5676df992362ff6726c6bb391902d663809bc4fc72af08",
        "7661c5d515f26ddd27cfc54c45abdd8cf45e330aeb2dfb56c2275abfd6da0977",
        "788f560e1999e2279dd2ef6d7c1998a83ae49ca669d22fcdbf437883126ce381",
        "7971854806a5204ecee419faa1464add3f8bbb84a36e349c522e76cb58e030fa",
        "79a7a29b048c9bc3481cd2e9c78390f88e19b56d5025e878c9030afe5867ab89",
        "7b475b9796df8afcca7cb38cee2756de242454ae22a80bf1779eadd6a1bff716",
        "7d9cc4c4d46d661594e2165b40e7a22616cf4f07f8c98b4cadcc671c40818f39",
        "7dccac999e14867b668f947cd2b93d2f1223b2157fd4527fc7a064c2d85d2ff2",
        "7edb34c27091973e280715731c97d83965b55660d7fbfccd9a55caaa39120873",
        "7f01581cc9149705d6f391d6f7f714b852302e4812759f3a9d2e177c52f52e83",
        "7f441e945d52639644fcc3d4b7e54179a6d5277b52e024dc86a61192841007e7",
        "81a435206db27741c0134f10a8216b3990c2f7918e624719abe70aa53fb48dd4",
        "830b10b360d4d864f1bd7c5cb0b9d11d0608fc388398a8e5f55029a9adb186e2",
        "839a842859229885e15bee596d9f21e02aad0ff302b1fe8d74f2615795ac014f",
        "89ca91930ea55aff34ba4afee0eaa74b51a1b961b85435e5e171c210eeda6c49",
        "8fad0c59e07238e4c82d3e6191ff17e6573470aa32b9f942e4b4e2302742b09f",
        "902fc532bba3a3b88b3440ffdfa4869dcc23c5f8ae41087231702231e7b43d62",
        "9788fcd33b69ed088fb27801ea9bd7a3611c0c5cd2112c0d07dd1dd4c9376788",
        "978af09c4293762902308b107a4881b7bc0871b32ae9fed714bbf5da619aec1a",
        "a5078be57f2f8521c749d0bb0f29f542686e47cd3697b92cc828abcda27943f0",
        "a5c5e3a2fbe6e0f401989d015fb191edb0b4f69720be37abb05c424c7cba743d",
        "a87fb4f6cb06d114586cc5e87b2229634ff6ae24b10fad1aa7d5c2b241086c84",
        "adbb0fde6af6f700729d132efabd7d5a8673db803007a9f4a8fe11110a9e479e",
        "b2be76383be6b3363f2a9da61fa2dcb1543a3e400b323ee2367075f31ede5736",
        "b2c1328bcc73c7e67ad0b2d74d8c7ad2802c596965f19917d5a63ec2fb5a8feb",
        "b48d7db9091c6681ad58ffa163717e63e9d997862a9f0f7a39e2cb992492be81",
        "b6e0cef5db537470149abbc64b8e64455f369fa2b1244c89028cf9cfe66a8834",
        "bba86a5e95a5d8c4fb711ce42466a1a5c6c21351eb7f23e84319087c55413fc5",
        "bdf69c8ef5d5e1a10dba6e44685060daa49963e2b3df6e185af34e6284c89c38",
        "bfb02d78c0b368479a34f271229157a3b8ffac2b6b8a0866ad8b30e9e90e0237",
        "c262b83e2479e74c9a405d14e721902fbd9a1d1e367a5ffdec5d7bde53b1f080",
        "c3bcfbb6d8f66efab00d4674ccb070a95518f42e6a61c8e060a78dc5616bde84",
        "c3dd99b98bda4b1c685b1e5d7d444a0337ad0b919fe41d21bd4d4036b0172cdb",
        "c468d3acdacd640b2a94b1669d1fcfb098ea9a173247935bbfaa7481cd73089c",
        "c6c8baf9b852232ac87b9dac5272ae20502495e3dc702fa0e828e40f2f6e8a66",
        "c7ea8dec1959213cef7a8b90d94b486c914d49bae4a69d664e281b95cfb7c67e",
        "d03e36fd3525cfd51274c4fda7b9d960ffe9fa2f2cd1c65b35927ca4ded20b86",
        "d44e9dcfdcd91cec872a67c33962c89532a66c3957b24d41d9ccb20489924b8d",
        "d77360924dba8ec80bf8e791cbef4c226b40a98a819b9e5ee7db2050ef97715f",
        "df35093108b1dad377f1a499eca7e4e1ba80b8de6706f8be52d79313f6ffdd82",
        "dfaa1354644f66c21d21fef45af82f64b5ac66896cb9ad66ef294e370b835a6b",
        "e163f7f67f346cac4b68ce1d1b925a6effdd489d16c0eb2dd574b38e8325e522",
        "eabbf20756e0d514a60795bb62ab1bacb670a330d5697bddd768d0f28b2aadab",
        "eca296fe00174e8baeaf66542a913a9d1a84b789fa0481d15e211672d291ec42",
        "f4ab37e4b086ae240ef1817fe810c69aaf9d6aed88fbc1fc83b856aad0903b66",
        "fed9dbc50f6e45e043ec3ec2f9d2b849a2725373b531061a307b6ca285b7ee01",
    ),
    "BSD-3-Clause": (
        "016915e593ccb5578e6fb221a05b97260b921b99c37e20297a0a754544c3b781",
        "01c8baf7c3a83dda59c8e7101b59bff0016b59e1cc26da2ba02468bf0e357964",
        "035ea2ad62eadc94dd052ad29649d3804e62dd15c7604f52836df52d9d7b15b8",
        "059eb33fa248d473c42dc3dc9893f2f7863beb6686adca540298279975d757f1",
        "08ada19c184e8110f810a999983eefc9c9f9ea83e223daf6c035cbd7ac400ef9",
        "0974d0ab3b4deb9b6e21519293cacb68e85cd19414330602b34f54bba00cc156",
        "0aa13accdea5db5d44c89ca1913898070f22ab631ad00cdb37141edc7365a443",
        "0d87a872f1f2e1f84afe08216cf26245f9036dd503740d4421bb3d2c979a69c6",
        "0dd71ba136dc9b2778261ee271cd095390b7134a7a822df4719a7c48b0798356",
        "0f89a93c4b574f9d657612594cb6bef67f521eca5f463027c6555052c27bff44",
        "12edb9d7a2f123f3dca578779664bbbffd747a6190aded25d179eb52248e3e9a",
        "1f5260593982c312894d9a856903020235f03bf49680cbc39e0d66eca6d8eda9",
        "215bca55a88a278d9012eb2569037952412ed212bab9959057930bfd089f7655",
        "222d0008814230addd1a3ec26db65a0deb239a9eec21129f8a655c6441aa2a5f",
        "22c6da66a8c4739e7cd3267d5b840520297dec31a91a9fe06ecf247d9925eee4",
        "24f91b8f9709c61977014fe766ce6c22f03bf469eecd36f31d838dcf4cca6752",
        "2b70e05a6fb99c9b618d8669bed10c91c8b9e64e906802fda6c462819f280b07",
        "340a29a01d41d3749fd03dbc3498c12550a23fb38e428cb8576893906157e19f",
        "373306066cae72f420640a91ad3af0e20abb9e2c981c4660df0e71415e443119",
        "394ea8ce1a85aabfc5751060844511f053d55dc61ca706b34b08117993b1b6d7",
        "4048dfedcd810c753116668707d0519e47894611137b247d9e25dc8b1f9a33aa",
        "41b14664a6d843b065968bae24ef0ff47f5adde010413dc4d235089a30fde0b4",
        "42ec3570bb31f66af1c1fcef261c82cf76d60315492dae405273e29e0db5eb41",
        "441f68f1f7a26e3f21b6a3022df4592f03b630484aba64380824ec0d714abd9a",
        "46101d964a781dc2e38cbe442e57c5d07918c7e4877c4968283813276b6448b3",
        "472344fe5f4c00f5a857185e996b760ae7115c49379eb66ebc222a4a7178c6bc",
        "4af76f6b1905a1186b51e0941ebeff988b0a3e53ec61a8b9d91a93a67097e825",
        "4b2928dd72293b788488b2ea066f4af49f769cd8ed6786d606c7712f790a39d2",
        "4eabdaf7892b3c8a897eda8dd7758a6df40d86a859591e01245de7c565158857",
        "564dd119681c5904012563e86dc1ee7a4294c5592eabe3cfd2f17c1e63df5a62",
        "5790e03b2cb70e271582b52e52680d29cf3710c7e4bb2239e59c2bbeb649ed44",
        "5801666b5897fd015794ef19ef079ceb4ed427ea77d16b18bdf1dbd6ba2c0f6c",
        "5f84bb38029c3b1bd2dc0cb5ca9da727af2bbc42b8349d6e97cc51f1945211c3",
        "60790a9e0dc65289eab79f26ab269f8ac2df9d0bc73571bf7c9fc1e6d4f677dd",
        "629ac0aa2688707444e5d6e23c16aa32bb2fa2733f0ba8bc9efe335b3dfe1c4b",
        "68957b1ab83aead90ef5782b965078144371adefade124eb8bcfda21b8f9c8c6",
        "6912dfaeafb25337c9f8b7d60cfc1a76c1d7d93a7dce0e88733940cd86891595",
        "699cc2e7db3903080be3aea2ff9f0117ffbf9f5173732cf6f72df738a1a4c4bb",
        "6b60f6e3d96df5b4848ff0118e040e5a2d3fb526983e509ba55b06acfe48ff99",
        "6e579f33f73913811ba50b4134a9054ea4db557ffaf364af3ce1def396507d19",
        "6eb2b7ff3f5c88ec0ee294a6ffa69ad5524b3e50c9599ed278774cc73bf15218",
        "736bb95de6325aa8f4a4476291d215aed04b1cba59c563a6da75c2df660fabf1",
        "741ab744d6dacf5361bf29fc9ad2dd81b71c4d71ceda9653bc8ee0925cf42d46",
        "763de41362b4f46d29b10fd95b489c13dddd6b12bc50222a63f66e6790c2f8d1",
        "76e09f8b5eb9824542fe1501467d15d4c7eddc405f87d8fabcbe2cd479d04351",
        "784d1a9dd30f98410f492cb15d52b02fec1010a2afee074e6c22854aeffcc8ac",
        "7a7567863d2e00453b172b8adf3576b0935d9c6334d85268e1ece1e9b5b3d05b",
        "7bfa4f87221acefa42cd05681450e6e9dfb99076f748d4ee03a7bf5e1aa1d312",
        "7c3c8c7d7a3f620d0a41eae35f0af224a4ff417e278def044d0e14d8e8fbe928",
        "7d23fa8cdc2fec4ff515fe7a0c7cb7458a1a39f916ac24d5de055373f1b646f8",
        "7dfff66592ba000bfd077e7a6166a9dfdd4a8c65feb52fca83a22106b49618bf",
        "7f0d446be7961ad1a4a3ef35da7ac7592eeae5fc7bbeaf122f6a4fcd593bee76",
        "8829f191d3a3a5e547589a0c8122ac4ca3e536bbf5ceecccd960642ca791c4c1",
        "89ea15c5379dc8cc917ae923c625bf46f620dfb5759d53f3c6c044338c8e4b3b",
        "8ac2bb85af0561e014dc773a3d4b6ca2a4c3c7005ea643728d8ccc431b75f4ff",
        "8afaa9e91ca17e15d208be05be74db94a2c87ff8337ba1045c2a6d5063f68b75",
        "8e547966dadaa33e939ae0bc2ff87395fefeab33e9c5e4d81df669f7f7cc5acf",
        "943592cf7007a65710a4d22ce6948608526d6ceec18d5c863d5ff319c35c91ab",
        "94582f7f8c9d18a174a3f7014c0d0af34bfb0f8d049ec5d8b4217a1220ec57da",
        "9467144307e5a5bbc14957f7c16a07cc107e786d85ebcf8497849089f908f96b",
        "984625b152a899971f170a295a434b3b959be77b31cf7e6d433c5c88458ef6b7",
        "9cf3e3b4398f10febbe86fc308f81cbdca74514282b46ff1dc782b7eb3d50d8e",
        "9e2f07a0c82ff43482bff706cbc423cac4827e70a3c7f9a206ba9a83ea7f7cb8",
        "9ee2b246859b749653bd7d594009ea1000b46c7bf0aaf24d776badec465a0ee0",
        "a2e9d26c0961b6d3a6eae8c703449ee615dfc4251e7193749d0622522ae44323",
        "a4ae98e9116db32a40f676d291efb9a536734a668a9af7633043dcbebf880635",
        "a5d52a227dde9cad15b66dd2383708d087c2625e2316a45439ce8f824016216a",
        "a69514392702499fd11cd179c06a11d40e313ed0e6b1040ddff504e3d64bf4e9",
        "a8a4f2f063645f8bf51074b94bf1f7fda01c7036d732462d91bbb41bf9c2ba91",
        "a8e3e406cd8faf74bb0397244e9da5908b43d294eec30e9dd96a1e8fd4352259",
        "aae10db90f745213a75fef1c05b38fb69a6e937fb29e021c42ba24e362d12c25",
        "ab12784724d906262ebeb711118b649225b9fcbb9a45e4fedbd5b20c4d2d6c46",
        "ab49cf99529911a1a005e8f32167c7b1514296ad4f93dfebfebb49009430b777",
        "ae8644200ca246ff7628ee492e57866efbe9c2516409e852ba93ef0467120ee8",
        "b385f1768d905e8467b1c617937e487d9c5cc0ea392ecb18e6b2e16d737815fe",
        "b7662e1a0a3bfb934de299d7f0ebd6cd94eb8403454e6f7b6b722df67ca303de",
        "bdb55b439eaab27281a8b4002067ccb8c1c782e7f0d6fb2d65b512d500288a2d",
        "be21bc8a6ef63e5c5e0dfb1b9394855d2bab20c54b5a2fdbf82b3a4e1550053a",
        "be9fc1bf956d067bebd2b9be15e961aff161d1c54123f6a7d3d0e4d5107d86d3",
        "c22e806f116252fbc1e50eb0a8fca9265cb1ade6934782e80725877f54667207",
        "c2e5d1ac22f2ac8aa15a54679b78e2f85ff4eeca0ce33f545e14202efc572128",
        "c390f8dce954ea7cc20364b1ad5cdd122731db1b622fa874ed464c2cca7bd35f",
        "c48c72be52ed7db75b75d61318c39b5faacf2a0c324c3330e433917f51101e44",
        "c8a6f3d3743a5c5d560179b296545c3bfa818cb4b37515c1b0bdb863168a4426",
        "c8c8df908b7f7e83d03ce7fd555c0c4d1b6d58cfe9b3109e6af7bc06c6014d37",
        "c9a73eb425338d856e3cbcb74ef5a0ca55c71196b5d492ce3c28dcf0618c1d98",
        "c9ce1bcebda2228ddf57d9907c5da4b3a8d10940c913bebb1cb54a61a8e15ec3",
        "cb94676a7d5a0ca883c9714f9733dda55555bd82b8a0751e549ae13e13ca6c00",
        "cfc2d201c487dc5e08cdb12ac0e2891a8308660a314b679bf64d9113fa0196a6",
        "d008d4299732deba79e6a3991bd0aa17507ab3a9b714b7236b80b14c24020915",
        "d00e59773f4ee83f6734c1496f7389357c5db6b42be07b63c86b83483f042b79",
        "d1378ae8f2d4938b7a4a8f03c2700b08f52c9bd89c20725cb377148a186bf110",
        "d28968932162b8433ef644845af54683048c707c041b34181b10d92f447d2a9c",
        "de8f095f8696dcfecdc8242f96d931373e13a7266ed84d03609fd63e13dfb1a1",
        "e29aa353114e138bf83b2bb21debeff5932bc8af0cfedc02816ba02781e07b85",
        "e383d6055fd77422b87f5b0ce7dfaa2f5e51ac76f4cfed4d7b34066b8bbb8e49",
        "e823a4e50437859738c8c7f90c80200df125c8a9f0cd6d037e17acc1246ed800",
        "ea6f031e3bf1cbf03e6573380f8c924523c177902fd5062b8b27d321fb0f1d32",
        "eba2ecd7b4cab16b361498e5f406d55c9dab775bbeaed362d9513a1d4f535a4c",
        "ebd97e69923e8355bf47d2fd285de77ae561ee5a64c455abeea035f8500f21cb",
        "edcc4f4417a26a1be4ea8e043735284492409d81b5a76d8ae29aa225bc0d8216",
        "ee52641ad306a9408b0928d682ddf4f6e846275a3491fb01c79e2f7d37aa7829",
        "f3f946d1bec44203e1f8e9a218b85db4eb9d4df701d198b46ecc4e14af0d108e",
        "f607b9549b8d911c5c632ff98bbef00881e168815ca670fa299bc7cb9f496296",
        "f7e70002ad15eead7d0ab06aa36b93c6b1bc46658b73f0f11286d2504cf6f744",
        "f82e0b56d2f4d1b8e7e000deb1ba64cacd121f14242608116437a14e75a185aa",
        "f85ad7be78c13f1d0320d396b9dae7a6aff975a6ff730f3f628d4654f4bfbd0a",
        "f87b0bbe01ee92bed147c440c79fdf77c50bbc8b6598427890ffe2cca7e4d9f8",
        "fdfad29013b3403c83dfd1905dd308f82cda18d4c8317b5a32ce9c3942d17f6f",
    ),
    "BSL-1.0": (
        "2106af3a43532bc63a930c82d2a82fe6e9e6eeafb03d80382664a07dd2094c64",
        "3fc8f145675247f7a8b5ab9f77e3040a9b0cab72c1dedc53fbfa3e34a5513912",
        "41919844fb179632b4fe3b0ee2cffa8ba33aea9d0cfa20f7025e50082363ca82",
        "48ca63c3e47fb229b7a3048f8da4e200c1789eb38acd6df787157b60fc1fbce5",
        "4fae986e76286a8400cc6883c08527a155155c5e6a1cb83b73f4db5a6c96a6e4",
        "53a683e95fbefc0edc722d7d8ed9dbf1d6aadb0e2853e147dad51104472e4da8",
        "620a7fbdf70607ab4be5bdfc875cdfcb6e4421c625aa3f084526bf2d8576c3b5",
        "71db1ea90e0180da37df789fa5644e32bc130cbf89f454825eff9a4fe185e7ec",
        "809e0d5d9c1e45b3bffd9896e4bb37f04f9dde565890c58c10ad6bc3ae4741c6",
        "844854a0c54055d9bc76a54e3c122b9da7239a0857400be278888cdea02a0e74",
        "8d41165580628dbfdb009e07b12ae8d039e6445505b3ddac310224935b8cca9a",
        "9034fe231ed7a7299dbcd8c3ddc22ffa505a7fdde3f533026cf0d1daadf002d1",
        "9708e81eb09d0bea6d98c8c535428f062e1bc605c897b4c3d0ba89f8ac77cc04",
        "a1c2fb2f8a13055ec8e18df3fd2bf1333f3765c5008362d3515c2c81ee642122",
        "ab1af47916093b80850b9b9bc686865d9c83e253e0080997cb57b3e7039c2607",
        "ba411d560418eec8d155b1bf59e53734f541d08e6280665a063063c2cc712183",
        "bca45a902c4f3bb721c8879d98b34b44326ca4aa26ac7d4e95ea44e2bb4c5819",
        "c0d23694064eba7585073c0b5522a0a45329c9ede6db16222b7a4c261f721b7e",
        "c66fcbcd5a9c457228f2ab1a5ecd22208ee609bc5e0bff262c7fa04a8baa1250",
        "c772de4dbeb4aa6229962899a2db81a8ca25d13fcd7e8eff6b0badc271988bf1",
        "c8d21b3b6f07ca2ce245871acd126860eac8c1b5d888c1b841ca48a5e96806d7",
        "cbcc9840fe9f0cb48aa3b5f97a7698b972f83568d9576a7bc1554a992aa581fd",
        "e261def6dd09cb81defa7e2b2d9b80403e4b60cc761acc8a01c22f6e8ec160d1",
        "e40cc119b45edca6d1252ba1c218541bb332b9ac2de35dc1eed33e01c9eeee88",
        "e9e97701dd304d2d48d61592a12b8e035af9cf1f4e54c18473ca3248f44a0e79",
        "f2f438ef5ba54d5a79a8add1b9bc1d06dacbbc858cbe3eacaea32c693035b83a",
        "f4187458bd0e9605de5e5b5e4154513c0685b9349d33f64e1b5028b188e621e1",
        "feca915437591926036486722f50adf7a2093145ddd270a0254f4f3c0498297b",
    ),
    "CC-BY-3.0": (
        "6a4aefd61c4a708d4e43bd59bbc9a4962debe7854a062fdd3a4fac4c52b433e5",
    ),
    "CC-BY-4.0": (
        "00defbb6b15aa698715e064444d0b8a826229908532570f60499c5b84b1da1e4",
        "06787ba2612b9230e1e10d42a15e6f8e0ac612ac18274fa1298d41fb0e05aa4c",
        "0ef7d2af1a638c1c5f1e03cc5ae906475cde770b3a094ed68f83440233303555",
        "151f1be9462bc7183716c7fe4e432ffa2292ebc7e2358b6410552da808ac5f42",
        "1d3f119cda0f9ddf5575a5c5ddc7eafea4f543f6fcb9f0bacba3db3c0dd68601",
        "25db7b151bf8cb3e438aa8f5c5487f8d07cfbb4aae8321a58baebeedf6b08c7f",
        "288bbd94a4891e6b6883ac3be565771df607aa307253a38c75458a8129240c48",
        "28ab122e72fe3ddf0a7116e07940a045f5df301345d0a69ce2ae15cde7c11c8e",
        "290348746ba85eaeecd57599cf1fbe37d6aefd68f35897d38fbf4f7d41dab665",
        "2a274ffd567534555fa0f3f9092ba0bf3a9186d7f416ea4d27847e13a99d31fa",
        "2ad90e3305bfb184277d399720d940c765327e765f07255b8f954c0c295a9f21",
        "2b926cf247cfc9ce171c9ba5d690492461711b974f32f99779e9622681c022fa",
        "3777a2c1478b18bae409b9ca715bd00c2c5a0d4e72b7976802a5676a434bebb9",
        "3b8fab3911ebb6c44af0dc74eb9b61a55e76f15a69fdeba891a997639d84e2ba",
        "4002172d88d1b8ac1f4d39ad0288cc0130607622b1a1151944318a0a167caf28",
        "52d4141a1d26b6fff4836b2f3004659d9d9577ba87cf2e266ffe2bb9204982be",
        "5961f71f9a2277ae52f7e90f02c882e24a56b98efc0873c956d3f0012a65820a",
        "5e613568bdb300b6618b5a44b1ef419159b8791857e3c3b343d6b090fb7f2698",
        "5eda823210cb907a51217f2fdc600d2a54a328d3e84f1a49c9974dd09cb5ffa4",
        "659a073599e66b7c7bd22edb7f9da3909db5e088a49304bfc8f6250725b58efc",
        "6a74174c5fc1b62a70d325e6f925a7e229c89784eb05d17740de9444a658f010",
        "6d9a1b9665c9177983824c4c7c522b8fdd62f4d679c15949e99571d58370aaa0",
        "6e4c5bc938f7ed05e8871d88536917982c77bacd721ff45ac2c8626c37865eb1",
        "70f3ec245a575f736fee97cc3b7a394681c8c8a8f94d1ea9ad28c97620561f0a",
        "7271c40ddbc70c5e44d792e8ac791d797449aa2da4a51437f0c7458e642149c0",
        "739882eadb4a6a8bfe4c4ac5022cc12964ed5b53809877f195f3eb84af6b55ab",
        "739e6bfc73643049dc1c9e2fce454cdb6ba127d8ce89d11895dcfe0454bb7eb5",
        "786e709346ca3b579f66dff051d6c3247a5050b92ffb4228de9eeb16adb916d0",
        "7e86a2b6a748e82873e0227e22bc5c0d077ba2c19cf1f0bf8d21f3a3b14aa8c6",
        "7ec2333790e475c0273c552bcb35ff2dda2be0cbfe0808a29482c8459bd7f671",
        "822b4d7dc3e32a24b1fc5c804d140bfe5d91eef8d5592b026d54843ffd09c895",
        "83212ce6133cdad983ddcf424b3fc6990a910ceb34eca62a79bf4685cf421920",
        "861f77c73274029abe33f8fb941c12f6583cacb5be6854b81a7b0ff6589be191",
        "86397d87417e8520c4812aa8085c8bb15bf5917473ea9ecdd0997b6885636e62",
        "88203233e10a05b5bdfcc695b12aced50ef62e5cfc332ed3b4a214f7c1728d40",
        "8e695f51b37758f01f15e4863646b8028b4306b7f2167cf725fdf1a1c4aa9f94",
        "a6e4baeb63c803af0794d28a0a90f26cbc18daad405d347e1d3d6e8dc63049b6",
        "a991907b50ac55706019cb7a19d742fbf1b08c537fdf4e1f7795406aa96305c5",
        "abe1f24477407f7523e4a2570805297d0205a021757a6c77244c59c74000a02d",
        "ace77f34ba41ec852dcedcdc4ec3186a9200f15b730a32e703b2072de8cc6207",
        "b0304085838da4f7505840df830088c6c1766690e56be81ffc46affc589c4837",
        "bdf3cbfaf3732b451244c77b2d158e7984fcecf0d3b797214e495266ff74b582",
        "c87915f49834bc0aa9c21cf97e080cbddbaf23df531dd8f69d91029be586de03",
        "c8e1f06f5be2a0b019bfb23c0e40d382416705061b53a2e6a6e1b59fb771684a",
        "ccc0fcb9e02c3a2f82249159fd5ede6ba12c0111284a0de229c7b4d0d4cbc312",
        "d1789f9984ff45433687c90187651d350b8e1acb6fbb9e21123be6e771147224",
        "d1af4d7eebb2870ad885df26fa23a60a82f9cffc16a08981a503ba67464a3092",
        "e74bfab1751688857f87b898a1b7fe97ae3e5ffd4cea4475ee0460f900a69c83",
        "e91a4ac33b2d943460e1ef7fd95b1071d7e74e39429de2b8633cd7f28b3e1a75",
        "eaa2e74e79c875e227a16a33f4333c6135ab008b8ac1098148e885d6fbe36ab6",
        "ef9a6ed2ce6d34aa7d1e971bb89816bbf5cfb1a4a1f5878ee3a08c2e4f17afd9",
        "f4bf8562f5b37c317acd09679b326883f75eb95d007169c629d7f00cc7a02105",
        "fb91fc79d132165516be6d799cdf95b7bb85acb4bceb39c59aa9c87db6efe1cb",
        "fffff1ec40a5ff066ae76e6024486547a7b40452a2e32489496d51691793af8b",
    ),
    "CC-BY-NC-4.0": (
        "10808329e8b2f601b71a335f23ca50c316dcbbf31949eb30c7dc760389b7af75",
        "11e6164228193f0d099d73d367b7529c64701f82636688fee03f5970b49199f8",
        "146b55c22b11cd040f64a25eef0d1e9be4722fd648dc07b08db197e5db640727",
        "1518268ad997283a4512dd741a6ad69509b1b794f7cce94f81758050be0607ea",
        "1962e0a4073d9c53fda549773261aad7ccbada3e1086b562a1f83b56a142ce08",
        "1f166f821993c0aec8a6c527774fb1a53730f6415a3dd8495a04956e13c7ecac",
        "228bfa62b1a122c42f9a42f1b8d2942d05ea6537790b50b67332ef079551ed90",
        "26ade00fad2f5b7cdf5ec4929deb2db184b9be82a2571ad66810df17f5ee9384",
        "2e85ba2e0350491d30fe745c79bed4bc93821a937355390106d9a432e6165402",
        "36f7e55e8c7d30ea8a02839637b4c639fd9f18db678d6ce64876e5dd25fa29e3",
        "3b64cd2f31af5791bcf3804889cd1f0066d38867063862debe052820f138abb3",
        "458915cc451dd8048a14b72ce46a2dd38b776bbba757eec0a8340080621aff80",
        "4645b77adaa0f0ee8b9fc20489665928f61fb8df820535a8155022376fb73d04",
        "495a41bd2b842e9c540d7582be94171998882e40162ee0538c122c9839838ea8",
        "498907bafb7b55ee8022734e8e39b3590fde98a9eade1e7a28f42f604ed34b0b",
        "4cde8e326023af77ee4c0178e8c1252b715aa212534987b4d35c0fda4f1da4ae",
        "582dfd8bb11a624fa7233d1bf83b235b238e2237a0ee33923f7db9c94fed731a",
        "588ef53673fd1385b3dda8334d46c1a9a6d97fb3873a20fd93cb5b813b6d5c6c",
        "5e581ebd627688e6f467aa5e88293e8516f81de8d1d7904553594a403d9b2b99",
        "5e7184629f10d31591fd48d6cd3adab0e28d705b3f2839d212f7a810f349a8d7",
        "6953210e3bd417025a8181f9d3968800801a6061ec6dc7c59a406281707b4283",
        "6b54e7407c8d515c8cb7062b75a21268e5d5230b9a25557969ba6c0ae383f1e7",
        "6ce3a4e67fdb484058fb8b7dc0e1b796866da2fe64c3603e89df492cab8f6b58",
        "71e87ab29b5d2f96709a6f35b0e0bf9cf8180ee0a4ce7fbd7308a7c32814f37f",
        "727962fc873cd18d66d6ec979df185f84a49cbef86c9eb59808f9380aa5f8776",
        "7418cb22c0fa6884e6fd43cdaef878e5b87032372bac52385d40a390962282a0",
        "7443c96a41531ecaf70f726e8e773289bc35a72c8d7a6facac89e4bf244caadc",
        "75ec9d0169f1315ea059a165ee5cf2d35423adade1a9e7f4e204281d825e88ac",
        "75ef27fe31181a13e72707cc911ec0258961cf3fd8c129a591af76591ca2939c",
        "764fd9041f8854fec23893333567c2877f408d020557362cc73395516d85f96b",
        "773354bf6b5f1c2cb474ce12cbb690a9acc670f6e62860a1a84600a3615d969f",
        "789a41aff65f98d47654f96c573dff21e9ec4b31e5aed554db3b4543380af5a3",
        "7ec2d95d0d28fc1ea2c384212a8248a7a21e1ce1f368b30cac61a067feb4025f",
        "8b2465544b5a10b5814cfb371bf02dce2562404c80e4200a7080811f6839bd8d",
        "92fda5c8175e7980eba2aa867ba26d66c02e4113b838793f488e54ad5b678e79",
        "9325af8829de643896537bc192e028ad5b5311e160f4434381c3d24a6f5ea307",
        "a3430d2d1af1d9c86fbd53072b6795b1d9e3d532f1100d91555a7a73e56229a1",
        "b12b64529e805aed409ade07fb53ec56d16802e4485578618965354a1181a3ef",
        "b80c95e1ea9e880f0db53dc8e2bc4f599c9acef58d3b9a9b7c823e6a330a5cc6",
        "bc0e58feeb75234fe658c1367793bebbf8bca0b5017f0d805836a9e2c33b606e",
        "be5fa88ca85b412bdc4201ac32096d9964bfdc09c4b801aae7c5113ed41f08a7",
        "c7af20eeb7305c41f4b610126e0ac275be027ac39d96ab015c61c3e6d0658636",
        "ce5df143207f60b1557b741057dec492c175aae7b06bbfb83b9374f5f3a43c69",
        "d1582ad34b928161349379ae1310406c29e889b4679908ac9de12b74ee7df51c",
        "d23ed1fcaa32ec9fca44ab6af0f1154ed811841485a9a5f0cdee0f5df69b85fb",
        "d7ba8268d082663aed954b3124afc74f1117a818209af9b26a6b8520daf97205",
        "d93a803d3373f4e5ef1a917798751f8f2540f6919dfb9ff865ecc487901d0297",
        "da2514674062e65f71eaac816c9c7ee20d0e08b14d952da64e041adf2ed1c9be",
        "f25b4ab8d544ef0de19d831fe22219df0aa2c75926033c55ae5dc0ebe30f2a7c",
        "f40b945cca652d274e0dd584015b89245feab6f073b446161653c5d647a62fa8",
        "f5c1b7bcef403c3651439de42f10724f43de976d45b712816366fda460941673",
        "fa09b9c5b2b2eb3539c843bbabf70561a0e19d57d6b385e407b69fdd4801e4ba",
        "fc778b6a52f7b8e4f388d689c3c3bc34fb3b60ff3e3207e00a2f9d513e2ee3a8",
    ),
    "CC-BY-NC-ND-4.0": (
        "0206c09744e5ce69cd8e880da0644c495a60d8738c066269ff4ba32ec887926f",
        "0766586f6bc8182d774131989e1854ecd772fd11ffbd7039171f2fec7cb8c529",
        "1103cbadda0484de3fd909e4816e3d76390b1603e2deaf126f44fb2dfab7ebdb",
        "1626130e9e009caf979caf8c4802be619aa0e8e589be8fc51903e418c7c5287a",
        "1835f2f91f471f175c1e280ffa4df8c026512d0db0d837d4687897b4f230d96b",
        "183ddd67dfb5dc29af89af1a481cbf711f019430be98a56217a354c9bea943a9",
        "1c4630df23a18f8002ac4ab4fdbfbf6947c16f2c5f31ea516a41c813a0eceaef",
        "28a3ca38ba565ccfe6da78e28e2e67c619269a9265b2f20be3c44340698a2f46",
        "33e80d159c050f5818af61648e7121161208907eaccd07c86bf94bdc4cb4ee0a",
        "3f3ca431406bb146f3d23bdfeef108f4803922eec5f07fb20870edd88aeb0ecb",
        "457ff3ed782418a0083651a7e28d7054d5c67539b2456b8219e04d37456837c5",
        "4bd8e8f6a5855f9f0e4fa13f241b7b3e116777180b3d46ac1589bd19fe66327d",
        "4d7512854eba02454dc8da36b0831072fdfa92fda511bd5d20cfe20d6157ea86",
        "4dc9b82fefd36abe108f251aba5bf31c5d91e84bfabfc691d5a0434562424e70",
        "4eace923feee081c09f3bbc307ca8b4dcba51c585300f220e0e67868e2817c06",
        "579d7cc5947109f2bffe758b31b31265b4fd90ba7733a993226819409878430b",
        "591d9659b028df15aefcf820e9743a137c50b2e640959b78ac8af15e4de3ef26",
        "60f22f1c70b59e649a561fac2bcba6d03878b2b1dc5635f3661b6c900285bdd3",
        "64c36e1884f9d14dcd08a1a33a44d7a718c88992609a670df7cf27d72d817cd8",
        "6956eb98d2360787fc4266a9f051d58c7a0d398dc4c4fed1c9662d306afd3e4b",
        "6a41968bace37c6fcfe124d97978e4d90c85fd7909b0bfdc32669a7020f960aa",
        "6bf5a5b55a5479b2e18a59278b8cde1a222e277cdbde29a430c1e1f3aadd022e",
        "7b90b85807aa23328ea611768eafb620126bd7c87ab1aaa8d46a487442460c21",
        "82b54f01c4692cc9caa8573dec6fe6069682b1b6700c8c65b91e47660824ae77",
        "82bc8a702bade32674b7f8cd221b7d9cb180af4a0d02947ee2f4657ad626f336",
        "85d8a4e18b7503e3d1901aa0636bbcef502cb28b8f6abdb3fa6d773eaaf13488",
        "887f8b4aa36c2638658abeffb02c86b8a7fa1af9aaf753fe5b39f2ce29565f6c",
        "8b52ca03322314e9f022ba760889c6f2a1c72ba18428071edee8af17f2246aac",
        "8cc95dc3c45e58cda4a2cce678969c0d83cf8981f4cd6e800e42112c4f00f7aa",
        "94a566a10618409bde4d0e7631310c32159530f5f83024ea2f6a33f2e934f9a8",
        "99b0d530407a82c1df7d720564a7c3185e7ee5800c9310908b9fd1275900ed29",
        "9d023c776796aeeb750b77048990d8be71d8432171b0d77886e09428bcb51348",
        "ad97d1e17a1b2c2f437e131954eac5ae34d4790c31cb4dc7896882aaf5ce40e2",
        "ad9d6f4e6764e8a70e6e5b30d656a119f20ac8d568816fbf588ed348fbb8b3ec",
        "b25bdc25368276d9ef073d6c53658412011f370d80375c6f2e1dc04422764cd4",
        "b2941c0a6de5fbe66c8e74d6f6f53bbeb0ac35d18d6d07bda29df66dc1650791",
        "b745b646874ad5fa766f7bd864a6c7bcc944444b1cab27333992935c0607416f",
        "b99c0eb4f4aeae380f74ea6cedd7c8f852d490a1c6ae6abbea3eabd036b7fbd2",
        "bb09056535ce360f7e4545eb5e03b965f7195e229d28be4ba4be0a9ab0abed54",
        "bb5ad0e8bc1164e62dd1b6f761589cd900d66410664394b4ed6936fbf02115a3",
        "c0af14c6b8b162b687586acab66f4e2191dce60139508a6737e9c3c45f6e45eb",
        "c18adc419cd0249f9dbfaabc0b44b232064630386f5cd9d0837e086077443ca1",
        "c322bdb7b5c3496627100bd368d02c64393321c63d229fef8f81048619890807",
        "c7dc44e4f26c2e61d3cebaefde85fcd7f62650b27a00eb4a845cd29a57494554",
        "cdf95fe6a6fb5cbf29e2e9a9fd7f258a248c34c09dd0aa16b98a014b83d76666",
        "d351622faa1bb285294727b6fa094b9b90943149e4d8850fe6bcce63199c16b6",
        "d5358e1ec0bd0fecb014292d4bcb52be50e34756cb6d23966460d563bd1cbbd9",
        "d6473eb8aeae4ef03aba568e365afe7264bc0c6d7b80999f1a23b1de9e3be3ca",
        "d7b3d02876be27a346044da4992d38ba45b3e16a0d8d099fe68fb26e0df82309",
        "d9ad3fb09e2951ed422ebd25174461d2842e64f603bfe5e49cf0b09f70f6d461",
        "e1e4de94972c1a63765571d90d28443d6ca1a7b839272db4d529c115f6aa42d1",
        "e8d78d907a17aed264604037178a923b597f56b41afea40d11915c816764a1f3",
        "f21c06cdb24c2a9130c8a3e74d01cad988adac79982ba1bfac205fac09b17bf3",
        "f3c42312b71e6b5efcbe7934741456a8770f76fb99007d7db86a7ed24fe5735d",
        "f4213f206b69f264662282c456b7db80b78aaf6a3144018cf75348019c0b0f38",
    ),
    "CC-BY-NC-SA-4.0": (
        "062dd0bc5732cff67c6ffedf199c9558f14b47edcc79bb679b18905eb3c15a16",
        "0ed93a166a5db2f92b372ac3a4da05abffdb4276f0b09dcfd8d3f1d3b5373f5b",
        "0f38423767ee762be5998e78449b372f180921e5ce5cd5ae75a4ce01e098468e",
        "15515a8fe40f1c2c58bbc0e38e776b0ded90ce1f36b31e3b3056111ad59b8563",
        "28702551b59e46097a0ff43a9310037fdfa768d93dc4ce5289e0ab75a64bb968",
        "2cccf2b5ed0f2f3574aba83b0a1a761af8bb7acb1ad94d0f28e2ad1333306223",
        "2d9231f6408a3e5a1d7f9d156964b24c8e5aa3d2457b0257a792d0d5ea09ba1b",
        "314787757e358cdccd4cecc0b10799cf7729ba9994e27d2740743fd3b2be159e",
        "32af1ec462ec020027cf19a360d36fafc8efcf65c43192f05e3307636e1f3352",
        "35baffc63604364d2db7a20e8f20e370420ffb86d2556f0b80dddca40a60d852",
        "36fbf70ac0e951b45e6d1df3983f1adce37163727628014ef51c20b60caad3f8",
        "48abd269c86acd0813fc7d9aabc09840e1b47fe4409e140dfa3bf8ee73f9bb08",
        "4f67564d479187395c0e141c6a799d0232ccee65c993f781ff594027b4f7fe3e",
        "52a189aed996493ffb678923f204424fef3b16a9cb7bdb86a14696fee29b9726",
        "5528437dfaa9929e69e87ff4bb3d315c04f1813ea2c5d9773538cc8b7ce73bff",
        "583517c22f263d577d4d1ba3c26b4cf907fa502d4dd367afc6f93257ee88312e",
        "5f7956a5a4d8b3556d2385c2ba9fe86eafe545eebeb5dd9bc028211ad8169f96",
        "62464c1014e09bc7835c96b010b55f97786662a816f9c22d74307b7ddc12367f",
        "642ae031771f885d704437e33db5c00125a5314c7581b12da3b226569a0efc7b",
        "6933041f1559d254f34ecd803c763a4f37f01097678be8ff853aceb2d7afc578",
        "6eea7a481666c5f22b78b1f23d6e966bf2cb1acdae298e5128e3c2d9e6a15f97",
        "73462661333c2ea7148c09ab5316fd7a8e2a21fcff9dfc9dab83793d0f616b30",
        "7524acf5e407b22a78081c5f508eccfca15ed16995635b3a18dc2acc772f6271",
        "755d88bce5cef30450589ce93e90cf13e079e6937c5e3d93b9e9f76d062d694c",
        "7a73148afc5c7bb0af1c8c61ec7cb913ae72aa5030de2b52d9838246d86fb268",
        "7c2aa2ae35a5070e63b3911134ce568e3059f2a02bb5e8185d0d796fd9740d3f",
        "812250322f1fe087856bfec5c5e685dd4a791ba71c13841c8fc503846fa9b55d",
        "81309aa43a9ffd787bdf7a3201a13426464576bc8f2e4fcee8c4c2f4656f2210",
        "90f0e7470becb7bdf2aadbc450981c884f3d6d78cba42085e9ea8f40e8369f3b",
        "9761f070a058e36148e64a3d4003bab4a49e9a380664a6c6173664567ee0c04c",
        "98a9d878b19860ae802288ccff47e64d54a77deff0192343e9c67d493f6422e3",
        "98ddfe6c8b38289386a4aeb70d1bf1e1338ed41cdbad5e750ea0e0a5d500620a",
        "9b455e1357fcfdfc11d5e020e177609c2e1e5ca5f0327e9169f3edd7aeff5e9a",
        "9c27875f9bc644d68ed8a4eae3d652c8d037f8636d72505e9421a77331062127",
        "a101085ac2c2f326c6ddd1a9538e079a4a887e4a0f86a287c905bc4dcc23f556",
        "a9e921d2f5ba786e0a46c52c5548030df83b67ba58a22a6c2256253c446841c8",
        "a9fee6244f1b0b8eb755f5d524b6883a34b595a2fda1a3e9253a0ac0e47da436",
        "b460f19b30f9f07bfc549cce6104b559bf6f7474da574b86e6a619401809866f",
        "b60ff13195c834c0a6a2245acd58254cd55903a9c356a87628d5b0d49d7dff63",
        "b885722c2b1f500bbd180e9be63173fd7a5f4596210d45242f1b5c21633270ee",
        "be0b19d383ba36f55da250c4bcf4daad4b1a469683014437bcd52f0216f0e66b",
        "c21c2433e23e637221c9597b13663979569014d3cfc474358b61b1a6ab8aa693",
        "c41f585c38cfb7941d5fd38ec57e11a4912189877a884c66c012709345854b2d",
        "cfae49d6ff2895d28bbfa7f8f7d28cd6fd0f02750ac3b2ef24c000b669b10943",
        "d7272bb27ff571490c57877f5bec1ef6e14a6c7f399df3d77949e93347ec8fb4",
        "d889605151673461595282fd570fa93d72878101495dca834a6f7b7aabd76120",
        "db64062dd9d4452ce4ebbe25f060558db70a541f8a112e796ed7f8c7b6f68edc",
        "dc2959b69d1edd1ff4ad8ed05612bdd9129229ed657843744eadf1749addbb5b",
        "dc6ef7b8118ef4f02144bc3a12a2c3a238895acbf64c09fa73da1b76e9b6b627",
        "e36155032ab32bbba617c7b9fdaad3066a1d33545c5f0fe1d4cf148d5dbf3474",
        "e5fefba76d0508ecdda99849103875b60ba3e847c99f0eec37da1f3137961a79",
        "e80c8ff6108ab4b32e2052a64ede236440da905835ae5597bc45d6c3d019e1b8",
        "ef67f773ea679f9a8772a59cdba9df53178fab7237a4fad452d6b4761de30530",
        "f4ca3c58a2bda50de5e187060585c3fcaffdbf03cb310a8efb37367621a8ed2e",
        "f8984a27182d234438bddf7f0e8b03a94feaddc7cefe4fc5fc3b5921ebc3de30",
    ),
    "CC-BY-ND-4.0": (
        "02448b8dbd0f6e1d59a090bb007591056c4e850a8436a202c3a4049d75fcc869",
        "02a95befcf2232c247866a36029fc4e97de58a22b8edf37b3a6a20b6134245fa",
        "05e9b6ea8bf0709e06e913f7fe63f8b921d33bedfc8cd361360a96b3c34a4a16",
        "08108e62c66688b99a62b7aa24442eeff7fed0781d6c8727ca0b3d7218ee788d",
        "0925807f6d4551f4a6780fed799f3025a65d4f1f58c79af83e5c4ff886a202a2",
        "0d20a674118331839815005a37d5225818d1917ad53382ea4992456ddf0f2caf",
        "16c129775fc3af1bebd12c2754f325470e1834375ae5b304b1eea3cd48c40ab9",
        "17cf083bb30b68bfbe1ce74dbbb4a02c26e0d260dde2e285790e5a0a229a7e7c",
        "19b861759e74db06bfed252615462e453e26e032d13f3fd6ebc40634ad4d2e82",
        "1aaa5d71099bd8c59bb85c84fd967a8b2a21462db1031329f193da3f11993129",
        "1c290c174b90217e94682126f4d7a12fd03257f0db97cfc4199591789f9b0372",
        "1d8da287f17c666e51004ecbc535f36f5ca3999484db072d0b679850a1ec1ff0",
        "1fb07ea36e08af29f8faaf7726f7a1a3bfd6829b55e924ea29bb5992ce70d7f1",
        "1fd51ed840689cb7e217e1d5e18704576515e7db418271d48470e389e05306f6",
        "25d2a932dbe4768e381f18076165d79545f5c8fb07839465bba0847979999ef1",
        "2e113a27fb17b73d5717f2b4b0716c2c709a1260458d0d32826c929bea363314",
        "2e8f3507b96c3e706ca7d329bbc22fc5c24616b4fcf16832c674555a6a552a13",
        "37c024d5826e8e4d40a14d08b211c14a3b28e6e52cc7ef9882defa7cca489864",
        "3c9bb3138e8e1bb778682ffd96c9dc21063ae3e7fcaabb1bc3f8dcb369671a85",
        "49b5d760b0a082ffb12e891a1914e367131386e2a066acf08d220e534599571a",
        "573719658b9090ac124779186d22523d0c2da5d3aacb4fb29eb382f3435327f8",
        "5850075fb40450d2bc61f5279234be8ce65d346973f366df19a41f1ce55594ed",
        "6189234f4f81d566688a7dbb97d047e3c10b7842e649da3181daa053f2e8643a",
        "672d313d691b586c9387609471f49e0e2cbe8cba052c6754f26a24bf9160110e",
        "68657b1a6d451727851b2ce69993e2d019c60a2958c29bf972fe8b42e0a79012",
        "6a5b516ae88859312f1d6a250547afd88fc670f2c8030fab5a84a9ce5a9a817f",
        "6cac07211702cd6bff3fd3018de24fc0f8e1b3d2a944acd6eb5a17d0ecbd088f",
        "6cfb8816b45feec3ccef4960d96f4de880b5371b0524efaf5fcdb98ae6282201",
        "73e950d885221f2010c4505b3721d0841ed3c60423746cedae6e2c32604e9664",
        "811f26af7837c0e25a6f301a5e47ae6ea8ad16b8898a8d8c9361c467fa42de76",
        "81de4a4c3792026b90bac27182313c0e77de76d7f8e25ed162692c48279a9ae1",
        "836dea8d6d783e96910516d56d63c223c8e1c903a566e840a4f5c9035773fee5",
        "866489b2904b1deeebcf8d19dcdf7f0ecf3b4c298676843d2d4efd863f41e913",
        "86acd863d354d797ec85c85f7869a69a4874cb789c0a78de4c1f6d9824cff183",
        "8e36458dbc389ebe40d6637ef01251238fa464679451ee21c6b4120af0f211f5",
        "91772edde67c4dba1a887e9f3c018920e7c979765185bf4029ea2ea8e90e5e6a",
        "9f256f40af16d8db69b368265574ccf358426b9dee2a03856f7352b462048953",
        "a05c4d4ec6e00822217dca8525b165bdc478d5e5b1a30b4f6564135c847fc34b",
        "a9a7f95674c4aeceb2aefead429dbf2b4b3315ceb136b39623bc0a4e625da943",
        "aa71c3845f1030d03a737cebd0b07c853707a8793959891d51db2a5cd7cff5ec",
        "b163eb88ecfb28b815c85dfd756d78d97435d58d4a5d76399f81e4d948f59eaa",
        "b41df4e05f5821637dee3e85d394cc6cd283d7e29b1d984f24dc48487a74be9c",
        "b536c40dd5651247c7402496700b4e7272348c186738d392acc5193f50770c5f",
        "bbe73d5bcbfbf84c89190e322d3df1bdf6243e669a457c2114564914bb7a8c8d",
        "cb2bfcb3a779380e0b69fb490c63091d808e76518faa2750649ec97e0f9ced8d",
        "d302c10c2d2ebc251b33d70ba6f1d573fccc06fefa35a70efecc3c13e85e5307",
        "d5a6ebeb82acc11018c315afa6fb03f178cf8d99f282cb5e5f90b4a484869f1e",
        "dbb68f2b03759e441ebbc8395f7aee45ea9bdd8fc1621b9203df93b6dc421704",
        "e1ece18264c7f46dc181263c1be6450e88218a5cb87629aa5024179644dc38fa",
        "e2f276df62f0a9abb33cbb8c2259956ffc3ef25cced698c3fe30c3f4756900f8",
        "f1d00e323e37ebdfbc85a78927c433757012dc81d49179eedc00107c1acef19b",
        "f47ee524fa666a824ba83ca119d74a524ffd3fe43951f819fb57b50a806e1001",
        "f72e006110ee8e5adc8e425baa1ab45c566ef58244fd26bad1b6c61e4a37e0fc",
        "faf97e1ef9a4d56ca9cd9a465c5b1cab1b825deceed562de1cbeae24ed56e04a",
        "ff796660b143cf94d9a5c6d4cc2943cc2a790e911c3a01197e41b0f75966c6b4",
    ),
    "CC-BY-SA-3.0": (
        "aa751f38b09e0105cce182f1d1e846ec9ebd4326ca0748497e67d372421a3366",
    ),
    "CC-BY-SA-4.0": (
        "02893331427d25d9224e9e07c1be39c66db013d1d0f1ee75abf8e0452a333a5a",
        "0ec4e047e736c3735cd23a05f4dbf8117e6981ce2b1ff25547d6fe18bbc84b95",
        "101974af3386daa39b5da1b66b3e4c6f04a8c80c9325d0b0b141e9e9a831dade",
        "13a555db5360be0f9bef5b6d4ba6665f457c07f21dea6337f000408aeb0867f7",
        "1a14b81dbd25f3f61723ec5034a06e53833a162b133993bf1a077599fb29f9c7",
        "1cd727d53bab2d29e919221d0334a03ca4574e9338430e1e89495ef614577cb7",
        "2033446bee950fcf82f3adcf35cbf667c2da6ba4944899fb9b812f7605cbc167",
        "213cdd84cf2a24ff890786d9bee41ca4de13198e9abd44d12ebb8e9633786361",
        "2f9ad5712faad3249fd10549c6cb2f3530218487e0802d500e0ae4fdfc2d7fd5",
        "346b1e7137e742bd5cae080be711a33bf01dd2ad30db7afe72c33361bf327ff6",
        "39a46887803c896876c1b0bedcf57d1cb3c498ba129ff4befcdfd7bfa0df5717",
        "3cdacf1035a414d270b8727ad8c85f086f27b5e736f1fccaee7504601efff941",
        "3db3ecc597e3a63bca3320d61e838ec8a2b3212c43f0dc02e368a6e6a094724d",
        "4fd4271f432388a1c759a997b7c3a199841cb7a6b1b20d58013482cd9372bb77",
        "5039c409a61061da133e92ef99e93e40c2615c4357c1a772a3acd7e3cf153872",
        "53a78248d62b02972c2011f8f57e5891f6b7a0ef14bf532644c8133fdc42dc1b",
        "5757927b52d1f2fcccf6e8679b7b371550b103ba98eba50db1b860853a2427b3",
        "590c5cf45d006f68542fc79a8e45c91f748dea0cce06d0c073a90f67b72994af",
        "627dc2f937ae7d0458699671aceaba083640f054a367580bf5411a55776fd220",
        "69dc3857f0aba651fd2a4e05cd1e29a4e7b52e980b9cdacf5d4b27d3495e0ac1",
        "79fce206f5647f9254dc0e1aed954ac551b11a73f1ae878c224abb117212b4ab",
        "7d6ad81106cdee777b2f45ca75a7257e508fca2e906861deaf37a84fca0b7644",
        "808fc082530b1ea262d6ec5a8cc582d80376c1b0f1312057fefeb8c91c1991a0",
        "815872b69fb0a90bfa0d77af4740f30352be3f417d0183ee394f351939ccd8f4",
        "848c1e13512a26624953a89adef600dc777bb705a939f2da97f598e978f07e41",
        "8617756faeb46596f0837ba8ecdb0a9f0ae1ba84ed6b6a38a7a78d3ec7d2c43f",
        "86ff635f83eb6f5f2bc4554e9f13806418f80044ec6b0d5f2a0cb1565c520be9",
        "88c9bccc4377509104b50fee244d17abcd2279430865a1b4fc9bc60894b0c0cb",
        "8d31aa8fbb90eb02e16b0c27be2fb18312d89ba0fb9595659c157c11947d4689",
        "8ecc059c87c58f0e07403cb106855fe07a70b2ab9b4ce7cedba87701fe867e85",
        "91f1be442521e259c3f94d65486be4523d01792f1b98033a673fe192d9b53d87",
        "960f56e14b7b1e59f45f37af6504bb2bb6eec500b00e8b6a874e38c0b5afffdc",
        "9ad4b966581ff9ca9a8c3834647576c11d7277ec80a667d8a06f81476bcef14d",
        "9e0179ffca473579f05b82c8e0865f2934877336dbc21dd96fea36d74494169a",
        "a4b2c3fbd5dc623f021ce3ff39b304663f2390e7d8864fdc4de7a81bcd1d5a87",
        "a757d6b72e4f2fd77dd74d386e7f380e876220ef91f4bbf4b6e4de0cbce47740",
        "a857685de996e9fd9d2ef6b1a35378242c3c7649e2471859777d6a1d70444591",
        "a86e723fa8a35674f995440cce2e4dee21c5fa46e0f919aa45623de87a111b3a",
        "bf1cc685dfecc7be8371dda58576cfd1afb5f3031c504589a01dcca79bbe0143",
        "c564f90b92bc680b58bfd3fb3aa844cb616e773376952b219d361a9d5a6fc9f7",
        "d1008230c9e38808b605b3aa7038a39fbf837f1f7cacc415927f2977695c6669",
        "d32fa3a043c12fc167e2193e7b0e29fb49212c624cfe588ed66a5cc0dc1669dc",
        "d49c8e5e5adc247476657b4d48b875c914850be98207f24a792ccdecc29834fa",
        "d5266529392b795ddd262eaab7a8a13c4dd6f43bb2a964d74547affb9f68cc60",
        "e1b0d36dc3ebfa925c49bd26ea79def81d2030b28d76032abc885f8def519133",
        "e3e71253d00613f6ef56723e9f3f4894de218e66342f2d4bd4c022e79c496af5",
        "e4bd1113ac3f7695e573d97e3e73fa39f6f5c3b5315765a93c54840bd5d63a91",
        "e9ee3cf4e922d5e372c2258ac8edcdc2ebbf1764c93609f1a230f4fe1770bb3b",
        "ed0973a681ce22680740bf2dc1561eb2258f10747e50f08200465f81b27aaa69",
        "f1d356fc81fae6f933d5378b03b2eb9e0bf78294ab1da36e1e602518207ebf04",
        "f350226c6fbea720199454d53887f64e73b116360f4ea083741216b6b4360a63",
        "f3d3c7d830563272cb5aee52bd7b52e6932ea9ed9de229fd3b3a8390f2461880",
        "f6c76a80276083e62453ce50a52b616b6dd7502dd372338c3b8d22b9f18580ce",
        "fb363fa5b92d61494cde1abfa72473d9e0770a130ad0b75e27e3d738b3d9a77e",
    ),
    "CC0-1.0": (
        "96915353d7a84082bcbf6b803c99c651e279a832da34fbea4ba84c9005155395",
    ),
    "CDDL-1.0": (
        "1581deaba61686011340ab17c938c019c22fb2789391f8e0ff1e7fa9374323ba",
    ),
    "EPL-1.0": (
        "40775eac86f3fdbdc6ee22a9ac797337780503ac8ed41dee5b3a4396fad4d6f1",
    ),
    "EPL-2.0": (
        "05ccc2f830d6a9b569150aa39fe4ebf060aa35b8310607f04d0c9727edaa1a77",
        "095a37ae0cde773b5c5964710f2a21b4f3bc15d0e8a7cb1d8d235eb83db531d8",
        "0a3d951b0a59ed7dd5af671d875fe7a3359abca6ee5edd8cd8597b700e2bb46f",
        "0a953c1449153e4e37e5f6738514aa8e69335cc58ab0d66a022961250bfb56f5",
        "0b3f9c3c8e7d1593679434a3182598c6674dea4257a20d9918b1b75d20135fe9",
        "0f2e73a069b2e731e07905154c85db1a4f7d0db2450c3f7114913255b20dbf56",
        "157b65ad7618eb6ca5416563e97758c7c0cda5dd9946f82236dd5553bc203561",
        "1764ce4f068cfe1de6230251a5d4220ab59a2a16558b5d9239ef42765d286365",
        "1a48167f85c4006561d09d7a977d04618eeb719b0e093f99888c5e7769488c99",
        "1e2abdbf87994f80b8015fb42980d6efc1845a3f0c7e64f8426ce241494f4433",
        "1e666cb13f421ecbd3c4e0280818d95813bf0b1e138c4040116b0ea627acb968",
        "1ee9a72aadc4c03b77ded7b904c6f9262dfbdcf8f74e60855a49f72d187e39dc",
        "1f4466cfd48a602c46e2737c80a1480503f24066ff02fdd935273848ad7c57fc",
        "203d62f91973cd428a6cfbe26948ba538825794dca7c9b0e16ad193be8113315",
        "29f7bf53838ca1535231f04660a00eaae725304a05ab87e2898b346a859b5a73",
        "2bf0fa35023303fc69a554a3b9ace7e0dea518b5e36cd4be66cb73f40634cff3",
        "32fa559e89aac113f16c9199b6fb3526405dc7ba59b24e3bea5380ee312d4f3b",
        "468295e2c6c1bf67d0126efd858a27135e37a220f720981b71038f0f56e60ff0",
        "478dc4d8b24f69118516e5c279a770a9c111e2d1ddf1ead42197740c5d92c4cc",
        "50d82dd9edabd0b8bcb6a1ee5d668c10be0ecb7d429c155d80c7f4b3b26f0bd2",
        "5ee13c4d207174decc6af5ab992224b8069f457dcccade60fda8127c725f2690",
        "709796826c17540c90b9780cca09094c69de49a22b97de833673e8b673243c80",
        "743eea4753db5846831221c2362c4da60bfd467eeca0d40e9926ec2d8533cdc8",
        "7db33fe1ceda396ee1f18e6616e567facfb832e62fb775d4fae5ffd27067bab3",
        "7dcbf52f2165ac1513a87b9d7fccdd6c4110686f343ace4bbc93862290454d4e",
        "80af8712ab839454f85c81493ca20dc20b2b4ccf38c456f9164a36d755119eae",
        "80b0f4690272307965865cbe1e423d0d1f1986838990ffa5bc5ac12c36f76e0c",
        "8555dd032f065f684de1d1ee21139c47d30f62f333357e2485c2a1fbcc76651c",
        "88c4c098b8a8defb1cb35e302790aad36f9d607e6e27aa1df8908da839b56367",
        "90a65326bf74c1a80b74cffa85dff0ddb4a9af3957c6eede6c6fdfe31d488452",
        "94b86e29b62ef7b0a9e59e1a5d05d56c7a77fb048af7972be8135ab311a50492",
        "952fa3a8e1b74d9fd59c289cc862580c87719e7f13764c8b1687f7456db8f847",
        "982425e09b82339ff82d527132d20fab27242c24f3027562c16f394d2e3f90c1",
        "9c82f7154c10ca3131f225e291f5ead95894bf23dd9ed54c8dc76271a77d27fe",
        "9de8713f328308e639280ab95195da010ea29b6213c8af43ee9d87baa2a1ef91",
        "9f8b03846de8d06d54850b5c810b2f0bef546556273632b6237ffd4f675c3843",
        "a3a19d70b5cd42b971fc6ded64fba27b7a8c860235059deb2520b35bf505cb6c",
        "aaa30d87380e176779a2c48b8a3610dc5530174fdff6582bd76bc73672694b4a",
        "ac155112620200b59511bde7b2e3ce45394c687644579daa830bdacdd3d9b1ad",
        "b824a3c1f909b1508303a4acdf2569859507d5a2fb0e41afb0df7aa6bca9ba9c",
        "c5799724618a7adc21d06e38ca9092ed589c567e72f8e03ac2c4b551c53fc321",
        "c71e9288f40ec01f45f62cf009dfcde3b52f07849f6f5e03c7d8530cbab3bfaa",
        "cecba54780c1493443201600b1ae376e2f33a6a6c95793cb6cd19c80b9ad775f",
        "de295dc0bc9f0d5ca7588d3f9262c23de8a40572bda762668e2556cb544c6ff0",
        "e0c9233d1807c16de71f751932564b73c800e27f5082f7ac6a02116f8546cb5e",
        "e3bfa4fa1dc4464bbff2701eb0225fbbbaace5252c25ece32fe51448f688f1c4",
        "e9633677e98b913bcb60464e7a974e0c7c115155fa51d80f3b96c82a2e4e7d7f",
        "ea4e3d037729d49783d4d50d0c3337ab903b373b6c593cf5b5092affba3ca40d",
        "ecab6593c8edf748d38c953ed583edb9a489e9d548da0934d264d0876efedbfb",
        "ed00bbb71a56add1c4abe6491fcf22566dfc7654c99e1a18b6d8a2b5f5b489cf",
        "f311c223af219b239356bb674f0563793c92a2c1ab11ec80c09cde05d621bd76",
        "f4100740b669a070eb58c3524fac5f4e3e32a433859f27deb1832f2137d2e92c",
        "f7b74a62c3e1d5db9e833694814ab44fe0782bcdc86f08b026d88578f35f702a",
        "fcc05611403d025c26351214a4247b8c70f2fe6ffe2f26dc0c141e91c2b3197c",
        "fd2cab004b02af0d28260fab59f3e2eaa351e954c27da4a5cb224a9e93af8df3",
    ),
    "EUPL-1.2": (
        "c5659da08e8b95dd77069477f2bd4ef50049c5ed072339f060ba67315cacab44",
    ),
    "GFDL-1.2": (
        "f77dae9ac9fe269843b981cd3a80284f671d82b0abb85dc57b3b2fc92e30c5bd",
    ),
    "GFDL-1.2-only": (
        "9e00a26f5a1e0f6843dda3eac3df9a025a1d738b9f4e21891d7ba50dde267ad8",
    ),
    "GFDL-1.2-or-later": (
        "d02a03b7ab228e06334eec5c213a8439a7cb4ed5be0edd453de49f9aa3e9aa74",
    ),
    "GFDL-1.3": (
        "aa0baa0c7605f65be823e1b7c089a3a5f7e5bdfed8e455725148fd18588980a0",
    ),
    "GFDL-1.3-only": (
        "f447856790fe4d15d4d2472a62eccb056aa3873f7da694b7c8162555213cf7ba",
    ),
    "GFDL-1.3-or-later": (
        "14107bc71de567ae6999c9708213b62a8a3a6c3c37530336c06d5d287c599178",
    ),
    "GPL-1.0": (
        "e9b881d9fa59c9f21150a745318ca5add23cba9ecf972474beced409ebab838d",
    ),
    "GPL-1.0-only": (
        "e24d0cd6163cbcbd554df6d9f87bd1fee415217b4c7d5e00b56474803e14e78f",
    ),
    "GPL-1.0-or-later": (
        "a9fcd96dafedafd2d7f57bfbe49af8e83f5f7eaac045e1653a556376d84512dc",
    ),
    "GPL-2.0": (
        "008621b3e5c051edf868a47c7e7d2e3ac0acdd1938dc11ac7d146e686e8a88be",
        "009a842f0936d74a34efb20497797ce99feea3a3a1c75e832da512549669a861",
        "032737643400b8a1eb4381a7b0f04bab64565fc61bc38a9ddc86bae84e589b8a",
        "04d63beb5f8f91b4960effc02842ba1e099f6216d51c7641e80aca2706bc3c05",
        "07b9c1af921272d91c1a01e4c025bebf037ae82ae3af520d0b9ffe0346ef1053",
        "0a57e218dd286d360671640aa2c609df0ba9016377bd6957430abc3d842b8144",
        "1184e278cea78de7f7db950972c8f7c41bd77b3376bf811aebcd40ae4ba8fc1c",
        "1200b1df6780479d6d25fb4fe881e3b782659b6c8a006baf63d37ded5db04d75",
        "13689d1c8b7e98bcd6549ec966fb2be92fd2f961b465235a6294cd5228c89e23",
        "1617f22a00fffbdc0e9a543f0b14c895af399978a72eea13032d16e4d6d2cc1b",
        "1e7396b1075ad6140193a59f0f9d31e9c800e81843ed1e3ac0e145439f532a6a",
        "1f5353803b817ccf71efc09addaf5971678e4b3c5e3e4682883eb9f53ac2545e",
        "1fe518c366bebc9237db364b0f6d5fa3fe2a1c203872930228452e764a981e9f",
        "20346c1bb82cc991c7f0a44fd999797a80c764f3fdebb5a2efe1b202441e9939",
        "285511e3d0b2e2ad29b89a3cb461f49b84769ca6e80f0a30a06a66d4dd83f877",
        "287ed065d8831b6c8416c71e1c91d211c15c2f45601576d4e16da29ae019df8a",
        "290cddcc2eedee455b387299154f37581d99f168efebf923828484b1b3e07ae1",
        "2a3896076326283f4b03bff1e05b43b2783bf0250f1d9bb75a1207a4d04758a7",
        "2a3ea240e03285bb2e631371ac4e95475ba1e2986e8dd29b516d34b9f3b64cc8",
        "2d9996316496bc71707cad40e59252477b6c10d4871b104513006b0dc3a88614",
        "2e433232f1992a243cda2645a99a05261ca146f92465e8162935b8c830c6efd7",
        "2eac7ff4b592a52bd47833c3fb5de17429f9b20fb11514624c8d75d1df1852fb",
        "2fcf4d7adb9885acd51e8f9696b02f111ea92edfa32115a1831e29c64b049df1",
        "30bb7c9e711b1672474607cf961730cc7868c11b99a7c25e053d86884be93caa",
        "315ac0ddca3c1144a78f79e8f9fcddc68e88db2e393cc4e2a64664ad2a1474a1",
        "324d41c7c8d7ed28f16ce64200b2198aa3ddb6d446e216c3402cbf0802e0d8fb",
        "33085e4c80c37e222fdfcdef93168531e7681f62650d54f24ad1aa582c2e7aa6",
        "36bb9d2a9e47ebe2417920bff8c2adf677d3d57630f032b24590cdfd03a66190",
        "37a15951ac1c84209953297f1056f2c7dca431dc7ff7efb97cb107cb592067b7",
        "38ffab62bd28ed3342b63c910e010e26f434baafe102a70f142f584fe62cf6d8",
        "3aa8cf9d18314dca5aaa8a1df336443977f73d3e7b37734aaef24948c1056c06",
        "3b6b57288000d1bdf7a25f4f059818b345ac75ed9fd8879a894035f4562a4c46",
        "3e378807f1ce26af69f15d13472e230934d65d4a89e040ce4925135f80909847",
        "3eededdb8113eaa8f60c09d1433d82277a8cfdeac96bbb4082778520ae0d9091",
        "418451bc57c49cda2fd334cccd8858f8b0c60ae14ab822f9fd50ec2b61c8e4e0",
        "41ea430034ac7b412ab845ad7f845cc53b3d6e2c61383523b3ebcb22838975de",
        "43574b6c8e7c129d0635288a79047069d10f54745d070d1b0b77014b8a6c3a3d",
        "43da9f94c3ac49dc793073a104da2872349b6116007f547a0c4ebb3a3b2b34a7",
        "473263e22ef2de9b6a1213dadf94f27c883a76b51267b277e9c830579283a79a",
        "4a20cdf0234d3ca6e00b3c215604746448253eabde72b6aaf8aab5a8859293c5",
        "4a77d0c9044241d8de0ef99bc6c4885385315544d52e7e161c7a8466895b6df0",
        "4b724d976629eaa2dcaed8203dd2f657df92c35d8e87d6fa32fcc7ca6571aa6b",
        "502026c116bb7f06283e7f18efd1befbd5d4cc88995de01ffbc14cac73b5b73d",
        "50dba62dd8b7c1573261419c118d7c7948d13e23d60f6a00fc538b54212455bc",
        "54861310f3298bfc0bcddfdf00ae9d8bbd9f29c51b903c0cfcdc0d89e28d5d75",
        "573451ceacde1aae2ec429aec7b2a2ebc2462a8f171d7c723bfc17e7b3d2a6b6",
        "58f3e38ddf96df9bcb434d1e54f0a6ac7430b40970c0c820c0860e08a0f47c6c",
        "5c6484bd8b2159b5683e68b063aa3ff4c9d5c20be3f690f1ccd882ac3ed3d5bd",
        "5cece7eb22d740c4bbf88506a20793c2d6eaba935feb7502b54a1eb6f4bf2d42",
        "5dac76cfe410a300679c51608e8e6137a34635a605f054e8581774810712f5fd",
        "5de8f9837e0b3296c534614b230b084c9e950406b038c40fd0cc2c832971fae6",
        "62db7b76040e0e43a95cb4bff57518f049cb861397bcc85e79796c3203e2f654",
        "63e8e5b5939ca0909c6d4bcd737089e2d99dd84a7e891b0e8f10734f85703ce5",
        "66a57828ddafa64433e6dfd1d8c88cb2b40cc5d8311542ba4f04ffab331063ff",
        "67b0b92d98cd08db8ae50ada5db4844531facf4cd9c6a965174322e5abcc9b9d",
        "68722e673cdfbc8b1d37210d5a86645d67e920d3c8565e11084d9d2e04d3668d",
        "68d02aca2f52d8bd3c8473b18176db6afcca069a2baaf237032c90a5ce79f5db",
        "6d890ae4ce23a3fb74dc4043cb1ec18d812d5362fbf2771b2d03ce4f69339ac6",
        "6dd9b6aafb357a7cb26c07761dba88bd50e243ec3a63770c1392c4a9cf2a5a94",
        "6f06eaf9d1b77865cb592c268cee7d4d9299a0a19dbb946922e3909bfb76287c",
        "70f423f998c258444ea1dc4ec4f479fd61433acc57619cde9c017e85d5391456",
        "76dfe9520502d9f02e4affe30dae5faca4c25b7696cae761f72f86638c1d854e",
        "7774e27623b493f18d68be20d83de429c9eed3452b356b338fccc0037bf91c64",
        "79e1e3af9e199928991f9a02f8f885f192e621522f5a971de72684bccf208dc7",
        "7bfe630c27619a63712d7c661ef36831ab9ac07ee0bf44db71f4853652244a88",
        "7e5fbb8cce53632629df04fdb23559c3cf2ac734dcbb43294429d0cbac203849",
        "7fb1cda98eb1c66b8a75aeb2f7dcb306882fddd08023d7b55a28d57ab04164d2",
        "8176c67707fc6bef37884b06d97c211c12499cfda2a4ee3bb82a091c6327961e",
        "85616565e27b648f0aa6772d0ea669d5013800df12f5956099b07361dd86f379",
        "895fe7fe6e1bbe570c1654ee0d7c2fcb91fc95e6f04297f4905911f9d011f771",
        "89a84cfb33faea541bcc15c8963596a81398f7b844628c42988496daf71436ec",
        "8b0ce0da9996bec98db1690f295764638da7dbba5d4daea106e29ff461de6d32",
        "8d988ec1d7dc8eeb387d4d14714bce5529a109dfccb36be412e0299ba087ccad",
        "8eab53a5a8cb7a0210b9d0a86e8318177d124fb1cc62d3eae67a51ea5ab85893",
        "8fcfe7a3708d756a9b67115dfc3a9d956d14eb40eede09f1c51eb50d327c7d70",
        "916b134be019d7c10318c785c7b2039073677ba3895fe416bebc36fd854ca4e1",
        "931deda6e6b71b1b794fb0ffe21631e9a6401ef5bc2a4722ce81beb19d94949d",
        "93d46923eb6ad11fd3ecbfdcfd65c80f504fa9fa4b1ed210c6b418f0a6e9445e",
        "959db3e6e4c66f303a2fa29cb1e1d5e48b1874d236792f8a85b4aecb06d4008b",
        "9689f773a0cde45f36beea98a3257935dbd98a03b9ce1c9b25c7e019bd4d5a42",
        "9912e4cc123167875177b525c1c21194e2a3dac405e512aeae4359c74afa4aa8",
        "9e5821a013eb9e56288e5a972bd5d8b99da367adc8d0fed74101864ed86dfd69",
        "9e78f577ecb7a0c908d8f800a7d6531cf701de9df5cc016aab39943002a66fd4",
        "a31669ef9a8721bf9c8e58aa64570c51fe2e4caf68f6f05fb73972824a6cd00f",
        "a3828db14273303de49351db2dff6e69a60cb992de93e5747f43be3d4ecf54a3",
        "a63d258ac5334143c46bb793cc3f629ff75837da13386ccbf0aa638aec18cdb0",
        "a6a8c9e7265ac074d5ae617bdb75ecd3b8ca142a192786827ba9dbb2527e58b6",
        "a9cff0e72fd66b5717b747437277c7e6a7180ea85e84d5b113e26733ccea3f13",
        "a9e45084528cd285edfd5eb3bbb8ddb006bd4ff26dca8967b3d4e2f76f32efd6",
        "aa0937f7fb0b833bf7e30d362a866db7a822875a3feb43f971abf8b962b6b51e",
        "ab4fd23f63861c31367b02dd8823e96fb2bb03a2aa606db145eb92eb6bdbcb8f",
        "ad9c0fcd7c24eb74d0f5b5b2a71eaf9aa12d200585433f457f0b67a666cdf4b8",
        "b2890b221b4b64fc1723aaac56bc4a7cd908cb9d29d3a448d5b8d9073eed616c",
        "b58f588c7ec681810f4661a872dd7bbc3718955edb837c5c0323f3c43d0a0824",
        "b611f21b6f8acd0da979640b83a7302250d55281fca85be18f892b9a349bf254",
        "b82b20031fcaf0d67547e5670fb20119c2c26463d1e9ba868d9a02b1a893e1b4",
        "b9e9d2b1fd8582076d2d2b08875a5139d45fe20f4741c55171e66853514aabb9",
        "bd130017d447b2c20479e8059a5f53bfc02399d13130f07e25b8cb2ba95bb66f",
        "be7e205d2b00383a3090b7743872a338c137dc3c4b0140d20cec3f73021d365a",
        "c03a833ec3443fdd66c54bfcc1ac487f43a9cbc24f709204581eb124be905449",
        "c2fd5dfa3b81e6f57b668628802447e1d0c14af03c70579e77b475d05517d455",
        "c6cb12264d55216fe9dc4d5387c43fdbf3931cbaac644740acd4e548f071f7f0",
        "cb70e85a468fa07070a081c16bee05dc1a4b616b7627188fb43f9f36228a21eb",
        "ccf82c272103565d3ec146606dde1e576100aac3fdfdd0f7a943f620ebf9934e",
        "cdea483e529b0f4dfdfdd347c334a1a1fdd6c34cc19e1c4ca5522cf44f60965f",
        "d01eb800aa10edad7efd05703a5aa16fb243d16f77a758aafecf1dcb51992a53",
        "d4179d1d63d5d9322aaf16f749b72a5d6a5c13f5f332de5f3bfd3f9070bb1882",
        "d7a92882cdb451a5b6904f86aa9ce53e439c6d9a5df94cac741a8a6f65747931",
        "d7be384767d4a70d77aef29dce395fda143fc69e1faffa0f262675957490e33a",
        "d7e2cb3eb0872564e82edb4d4e9752e3688baaa4c0deb386623c504b4fbb5044",
        "d7e54ed359f3ddcb493c6dc153b918629b860494a4b21f77a0f3c0071b04ddf1",
        "dc906adcf6c70a2d77703a8f3023719fc1d6e703eb76ad9a6ed2da1fe92d107b",
        "dd13e8c800d480400efe9e88ac1b5dd1d6049538a2e69bd5dcb2fbf92f24d97b",
        "e0beb4e379d8ed1e3fd54715f36faff8ddaf8e9293b563398dedc9aa6e42214b",
        "e1640618cb7a3f2fc750c20a9162bedb824f7916fbfaef6f76ee41794b4cdb44",
        "e1c606857d1fd5a460a82fba35638266cd97d0291516d42fcebab712f92efaa2",
        "e2bd3aab942710d935f490af4d4fa3e7f410d1530fe297bff2bfc4c04bcd671e",
        "e3283f1389c6889284832f13987eb329ae59e58dbdbb0b50f547f6d15fef8fed",
        "e33faea19010e826c3b259a951253a564ee67c58af8e38ddb58f49d2fc272857",
        "e4024a3000e6ab4a43ff31175cf4e648b6caa851040620b659ec9b7acd66f170",
        "e753bc9891d83c40c0263d98f35f73d47b3fbcbf41a8824114a8b63abc3fff8d",
        "e7d1db55396811fd22b22fe393f45522b28451fc3d35020cd42878e1d4999297",
        "e8eaff7a6f0104ca6eacde1d8ad72f2adf0abbb64bd68391f246c4b2ed12b25d",
        "e9b4c2a0def0fa21fcebdd5676d91852d6044948efbea9ae36ced92f024d9907",
        "eb445deeffafa47376376a63ddd70fa17fe7a8d1d11e248b39710dfff0d2a6b0",
        "ec6cd22bcfdc8f83e123cf6dd13a27ab3894746426d85e216420f65afdbf0ca3",
        "ef6e4e73a100bf47cda7e29e256b4965a7c3b4a7221c065d00930f064c1098f8",
        "efa9f3f7bc9853718a9b2a7b35df2900944b8d7e1b3686b67325e29f425ff8d1",
        "f0713d5f90156b6d63946fbb08b609d589c3c425e3a3a946b0522689c8a213a3",
        "f086aa5a7831ae0c3234f73c2bb025d4f6b69aabd91d84a8105c96a7a5b0fca0",
        "f13887a6bad0bb7c8449283474cbb15b14baba76d2a64de0c3bf8ecde4361157",
        "f3544664a68739f190dbbe782521f13c51c2dddc8995e14f3caad734268d7919",
        "f3ffa0d0cd1b815b90782c10387d5aa11de9854c9435da1c556a225532ef4264",
        "f71bc260aa99f7eed5f23268fa6f0b7c6ff47eff2d26347b3993b1a241ff82f6",
        "fa462ae11f90597f19c6ce715c935239cac4f3fe161d1ecb05a88d7bf412c5e1",
        "fec8ea1d8a9928155394283e680f94bc9a9905eb7451af81611206ce428d78a9",
    ),
    "GPL-2.0-only": (
        "0e6b0d8ae1640cddb38957b1a08b80e984c3f0eb62267c6ca3442ac53a559235",
    ),
    "GPL-2.0-or-later": (
        "ee767ef3a599b72320b8b8b2bc3668ad48821d4c817f69d9335b81ce11cfe787",
    ),
    "GPL-3.0": (
        "00330f75752bed26b41cfd49f34586d5ea929e0693665e85dcf34297922c55f7",
        "0365da74414f905e23257932b83bd32a070d0d5b575d3592f39ee64cd3186904",
        "03b20179a97db8525fb7a17b608ddd0f20951885c98908ddc97b40065dfec08a",
        "0645b0263799746e4d5e0cdca6a715550b6648ba6de94f7d60d8dc91f33f7b32",
        "07141d23d5f8440305c303b661ca0956b710ce7462f978c73a77e2eb1e351490",
        "0ec1be88ba6473a111562c7b86c7652bf23fbde12843224aa9948737c8d17d4f",
        "15321b4d3ea2a35aca18353b6514c5477e7dd3c2959e71358aba85aafd2c5f55",
        "16809b26d425ef78a63c15c7f2889492f0171399de4cab8ef099927147e459e6",
        "1c18d3de90394fd16b424174f87270c58aede8d155923783130d245ad4214e3c",
        "1eee02869546a9bafb0b5fb45a8bd8ed16ed91e44f77c3f4cb91df51dd276dc4",
        "1f63fcc98b3fdf2e8ed39b5e6eeb1bd054506fe5f633dc68e4e0f9feb2e3c7f6",
        "2077c766a6d19897a743f0f83f5d18b8e530eaf0fac2f3f338ddb4573471f2a2",
        "20c06dec33d00f2616af37fe3f5ebff086b05cde790fd9b9166b47a21a0973cc",
        "26b0f5d477362107e1ef1f3a063e5163f45ea9fc27dee89d43ed5f26214663b8",
        "270bc2a5541dabb5dc8339b22e925366f1b88e9b34b00f4435f8e987dc0e0e10",
        "279c0044a483208feecd624e502959c7f751fec499019c0f4bf263487acf4b78",
        "295297341e589242492cbf7d5434ceb2d389dd95a11aae0d6e38cc21185e50cb",
        "2acb648e52f59afb6acef2193769f2da141955e97e31d6687b540cadaecd0d0f",
        "2b7ebebf901a43ff5f90bfe635f27723f2dba2bdf15b43bb7d6c7397a76e8061",
        "2c481980a13f9037c3f3704043858ff03fd52fc9251a81c1771fd6d3a38be3a6",
        "2e075e6ecfde416d9e3105e5317231a659829054a5ea44c65c3f3ccd9444641f",
        "2fa4b259930b54c0c71ff4a1fa86f758a1e3170b471c6bdf0d83ce96d44d6607",
        "34964af5efe4fcf47d319a84992bfa28323b94ccf5dcc3f7a7b3c39aca13547a",
        "35bc100312d76bb6b1f19b41f334de649c4647d9d469c709374ed34fe4edcceb",
        "3673fb3ad4e1229282f40743252de63268e2c8966ffd0278a2df1d3e5761c14c",
        "386de43388b5f46ced795c06005a74c11034f1bedbaa90622572faa62b552726",
        "39e6a1b827784839737d3fb22f256aa7b5a32b848fbeb9e2d943d86a26bfe41e",
        "3d3a6143f88113ae90e20dc5916be1de1c7fce317419c04e5e2a90eecee69d4e",
        "41b2221e36556728e3ba4382492872e30166ff26c059f13d14fc8e251f8a5a11",
        "424e999fbd14c448a37063abe90ab2e69815f2d25fb3420504c654d2da1ac150",
        "42808733b1c8eff348e10e2643b5f231fa5a1b8f9a0d8430f6d01a2a8bf1e690",
        "436cefc9a35d53844832b5478cfde278703ebca91d21ae02cd3e71105d6fbdf5",
        "43ec0f9d0637706057e4add1b3f8728487c5fbec4dca4796af1163c9178186fd",
        "441f6ca68bc3620368f0cd695f3ea47d7d6c092beaa3f36e82a91b00ce6a4358",
        "473f69a037c1f4824617dbf0b4a8d7df82b6d372509e57752820c5ceb9bfa8a6",
        "47e104adf06be2f6da72027568c46d882ef29ffe64f7975c717555e4461bef53",
        "48c9d563e7b939af595386ff1c6ac1711f3d3c9edb18345cd8db85663bbe6c10",
        "4c10d49c992bfaeaf4e59b7c3363b0a3908a7347fa702134b0fab8d93f0e80e8",
        "4d5a382e7f99124978ebd02dfdb1fb5a0b39e466bce523f17c7edf363591d0a9",
        "4e7d79ef051d3d57aa5647ba62bdfbda8e48c84e22f4fd6b5fb5fa2f5a350228",
        "4eb1cea3242c8b56bbe8bdcdd19957e9d842443286d531a0a2e9a6ab78480416",
        "4f19791d197cbc9685ea4137ce05d0f40a18beb96350b72cf369849a81faef54",
        "500c45c23543213e5efdc82d7d699aa6e714a2f3156c5ac44dce6500a86b6d25",
        "5382e5029d2b486abfc73239bf4dac3ed7ee430625b0a1bc1029a91d10ecd603",
        "55adb5f0acb2286757d2c3c1b10dcdc0b58c018fbfdae871eeb89a115dd7221a",
        "56e75ca1a527010feded9f88587adacb3b2761e29da15f6d7cdfb697f484ebcc",
        "57ee8c0168e190b715010c26d362c9db8c8100d179aa1a9dbcc3e0b86d038f46",
        "5807308adb8e7c94c20521791518e6cd10d415610e9ea295d67f208ab611d631",
        "5c0f298fb697b946b52b7827f8d9d5821402ef10b40f47f10605dc1ed0578132",
        "5c24ad64e2b1cf1082c4d457448ec386683e2303c4b5a634b2c97c06c327a9cd",
        "5d4f9ffe30097bfca39db2e19167e20ccb0cf4a5d90cd9dec69c4f4248d33ecf",
        "5e0605f99fe8e757b682152c7aff5b68e73bb31cbe41e66ee2c91e5af4239cd2",
        "6063f8e4eb6c0fffc53180e0b8779125dfe0e1228734499fc118e6b7f7f55860",
        "60d6cec3037f77e9abb91c976601c6c2091c33e9921e5a073c2078951c95e4f6",
        "612a0589231ea988fd5045f336635cfab8018305730bf05f5b9ba0ab36908a07",
        "61bc7038b951946dcb74f4ec307ec8e3eca313102aefade70341d5d363e72f32",
        "640db35b2db63cc410457298ad2d4308ea7d2531c36ac5ace99fc89080570440",
        "643fa804c1ebb4398f58cba8ff7c6a7449359b8afd12c1e8291a30fb89d60d83",
        "659901cacf8fbb72256b025eb429e9154d62c3a733cf9fe195debc51242a773f",
        "6659e46653796c845a7dc097b47350ec14de9a89b9e70f1776ac99651824af28",
        "6665214d828bcbff583f704ff43c7962b8939052405750bff2c3e4fcdcbbdb57",
        "6b41d5360c91d495da093471995c823ded1137efdac5eac214b9036cad5cfdf8",
        "6b530de3f8b6db330ef8e33c045e58f2e036d16a4948c14a6abce3d5ac664dac",
        "6e227e443f790146a90bd581c439f27b7b6292c5ce901bab5f149325468b55aa",
        "6e6cacd83a8fcbe5a7fad8985fdc3f6c38d1257fbf50762ac7b0b4d4935e6fb3",
        "6fbcb3ee7f714ecdb7e6f9ee467c813694a2e8594b5474e9dda06683b81670ca",
        "7301600d308b948995052a28596bb1a705b28a9547ec98eff516800ea5ef74c0",
        "73847d1c35aaf4aabb7272a41cb543cbdf0bae2d1bd83759753b5f978c16561a",
        "748ff304e51f5441180e3c735752daf3fb8c0da77df8e3ca6821ce6147a63528",
        "76f2a0a4777bec0b5d8118adedbf28350494d9d0b74aa43e5986d80e8d1f0b9f",
        "776fa4ab2cb7bed45c927db3f719ca693ef34ae39174905146a8518b74d59488",
        "7be1bf63f8c1628c19b2bf0922244802a9ae13c39d99ee8baf80127e8ee80e5a",
        "7e82f9fbedfce1e37cf8a154c2ecf2b91774516f5da1d03f3b92e260ccbbd299",
        "8ae1ab9d27739739b0da448aa0b2a1d55242593b0752e7b00542b2f636424267",
        "8ddd992786937d2aba38a3b2ac7d5e4c127f844dc4401af462f9e9b362d5955b",
        "8ec228e29e42317f187f58e16a2d06d332b0c1fe540ae2bf1aa7df2cc1352baf",
        "8ef00de43342d5b4b106ab7b4463c09a19cf95a70417f35442ad28a185865938",
        "938bc137f3cee7e6b0d8bdc93471ffb70ba30ac443acd3cd1c0dfc62420fa7da",
        "93e57b70ea9ab0329f67a115bfc612fd334a8bc00bad95f49ff05d5d60c7c8b1",
        "96ff45f55e70d650d8a6089017d9acb989980367aa9b3d80dbef77dc3162cf2a",
        "99775ef9631e47ab511f5afaa04a487571aa7003524de0581688d64b490bc14c",
        "9c7dd222ad9c78a639a06bdc09489da0b3f58c9ff4ed45d2dd3a9488c07a0ba8",
        "a089afeb4719eba62b43e7ea094b1dd5161107cad3aca57d6027a4d989cc1988",
        "a16e1983fb6644b1c46f6474471028872637912e98287ea79fbb37746c99c845",
        "a2dce0b496f69ee3d70a95a64665b4ee70c0a6eb238000f29d79af42edb56f2b",
        "a5aec7823ae5899c97dc9e2b84c1ac773747e4336649aa41e1d16448875cf7c9",
        "a7684432c7f0fee652bc9109a1e907bfb35f050ce523422d582ade0a216a0603",
        "a7cfb3d366d34cae9085fed8590a5463bbf7c5e292980b2060b378867bfa14ef",
        "a7d312719151b4d0f609fb6fade144037b4569da2544baa7049b782110bf1686",
        "a940c6b68caaa0db63be86df91a7a8e92dcb139671d46fac1ae78df352e6ba39",
        "aaea82be78309c3ce1dea55491a8f60c9b41c0f4b3e7c7e03bfce2bf5ebf05ee",
        "ab317f8fa337bad0c4dac7071e579f4d6ba4c7addc188b16b2cfd63100891389",
        "b14f10adead2f5978a19aa391eec349e10473ec4fd2abfbe693d3ad3a81bde00",
        "b289026c68810d103004a0c33342935c5d3c0fe6c1ab92b0c23495fd523b642b",
        "b396fa29017a7cd668c819a12f245b9d1ee78e2f40f1b930ba8f3ab0feb54d11",
        "b45b812987a600117a91c223e9cd47b83f1c198f7a67be807ab80a1e3771e359",
        "b5c624b63080ac2f4fccc8d6d35b5088a2be75a3f6b1fc179ccf74a364fd1f99",
        "b6994cd0264a33b3a3b4b63b64eb018f9aa4719934eceedaf354f6b38a4c5127",
        "b6e33d9595ef9bfc760a38510eb4e8314ef2f50b2b2ad789ec83a3cb1226d8fa",
        "b8eb24c8a28e99b0edae57e9f6ac901713262a070172e62b870c9f490c0126ea",
        "bd15df9ad7f29ee8fbaa016fcd3fa4fc127a22964856091f42f48b24f4fc47e9",
        "bd2be8f14971d57511b249e014186ae9a9d5a7f395e5118409a242a02dabda2b",
        "bf7aa8a8497e60d2ca37f349ea796baaaf6027a4cf333ed91b6fe03b3714e7ad",
        "c083863f86cbc8717a85a4abe697dab6da43c38e3ac4d27582c05c2696ed0bd6",
        "c70b445809fbcb416d1f0e6c589eb5900a3d19076ea0613162a53b0a7f0cb320",
        "ca46f100b024dab49928579367a2be313cc58016b1daca389d0634a7f4f8ff18",
        "ca8ad8e3f7e3c1cb7685510fa6d183cf5230a3cde0333979fde6673093cbb328",
        "cd0eaf1eb2a8205b42ec36b488dd2c4e02827bdf09fbf47006876aba4dc1cd66",
        "d0a23c10cf452aced6bc791e6d5c4941e984235c3eaf6f8deac993d9f034a570",
        "d274b3de4657ad26d2ecc2c9a942a48bf44d2e9616efa2d8b2071dd065884a83",
        "d50aada22e8881b4c3763942d3e53003cef9b25274276ff7385c4a9af9718e1c",
        "d55954df3741ec8a6c544bc8cf6ccbff296744dc8bf0227065b99c8ec0b00c95",
        "d620439ea404ea7fb1c8232accfe4e5b5ef8f37840d16a4704f603f2fbe5bc44",
        "d892c9381d4f143b363e0d0e67842e8c803995390875009c9778f5083c72499e",
        "da9a2c96b6b2bc88111247d56e1cf768723028adbecf7b7f1728e6be625d6d5c",
        "db35601f0ef8a3bf4b8666893ee1c24a05b4422a1925b7d100f45473c0bcba3f",
        "db5b0f6150524f4b4d713f224f9d368e1d0aa083d0485e8a7339571fdba7495d",
        "dcb0debacd4dd91ce1be362274d069142996e1491920d813401f17288842fcd5",
        "e1631f532a3de6e6cbf102b5e6fa249d977803c29e55f67121f4b98efc216829",
        "e3c1e17f0ffdd52506135df8dad5c102447629eb0ab3e1023214ec5b01d59263",
        "e419d0298c6dde258dd75fdddddbaa15a9d227637efe7bb0f9503da1c3aba19b",
        "e863f68bb79566e3ed3087d2d9e576f03c073e25fd66a6a22ced0aff0b51bb26",
        "ea007816027dd7ad7cc516fb1936d9d0e3a3fe3c6dc3c63b709f4415d1f0ebfa",
        "ebc7f80a179abcfda35e7c0c3834e3cdc3a66dbda0e5a02cfc90eda9d9c01a31",
        "ef0a249e191ec3b4c89064ec586fa07bebd21dacd0e635ef240db444879c3db1",
        "ef69c9e2c4d053c84b1c3376fd4f49b1020691de15e108134ffa46f3c62be2f1",
        "efc4caf71bf5f7ed42cf8bd4661412f536099a08362f6d434960c4e831242514",
        "f142e9ae2e4b00f56185ffa7719c823efff148c1f4e0e7d29dedd492065eeb93",
        "f3840557c933a022ec46241340e344789094f2f4c32b55f324b5d423d3c2bc23",
        "f547a4bfba9e444c80d7dad05ce6bc9a81f8f93bb146bf921b3b57e36fb7edf0",
        "f9702df602fcb661c56a615e11a667753335b03c0ed0fb7e4f2834bad12b8b39",
        "fb175210d04b5b6ff57861c45c0bfc9457dc632d4adc35794bcd9a1b056926f2",
        "fccad7fdeae7a948387b48efc491b7a7b12e4824ab0c771dae6938d13665b874",
        "fd8c1ea98dcbf82dfcc5e7ecb44cfc1b8f73ed0ba76187c460acef5573fdc888",
    ),
    "GPL-3.0-or-later": (
        "3f5f817483efbffb26e869e09a7c038be5cfefaee344419606b463e6909d08da",
    ),
    "ISC": (
        "0ddff3eb02f6a6fad4061291fdaf6554ba53aed688b11dd30f1f4a66f8e52055",
        "12bbab2f7c746f45f43e0a304423e25d63afb65690f42b81fd795f65109d1489",
        "16036757c6ac99371da3e82c00c06ead24a8e5e4d3fb70e0d3b37b8110c3bd84",
        "1b260e49f37703add20c838d14f5e68ce5627f5fcb5d2d8e5cea7b74b6f891a1",
        "1ce3e7978167a061a9d9ecd69a875abf71e590d3d6a23192b38f67a416b6a979",
        "215fca0fc8e5fd2663432004b596066461d94bf24dc720b62d70268daa51212e",
        "271456125927683c614b2b2f1a7a9d48eb8f69c813a2bb3d43a71b55aabc1d9a",
        "2785847ab9fda3870c8cc2417193faab00efd14b78361ff2db72cbed3aec65ad",
        "3170dfd2b31271adc764a34f5cb8cf73a0399cfa2cfa2638c888486c98977ac6",
        "355af2c28f2bf0a8db98bc7d7c788da0a376e41b36cb45d9916e331bcfafb02f",
        "50dcab424f77fc5d0fc8371628f45f445a5a569121ed18f2270408febb39499c",
        "601ee9d502b4a427d7d44a693df6cfedcff96d4b3c60dd633cf66bf2ceb53e00",
        "6e8729dcc3e0e1d81ef8f734b518bc82b377874ff715f92ee6bffc9cc75c52f3",
        "73f4619416228951c6e31d5e424f8d257f8ab377d5378f16709d36502a072161",
        "7621735ff21acaf6fc994551d7bd5be2aaf0fec49e43f54e357d5f82fe18a84a",
        "7b13a220415ee391a6bfce8c31d93b32ae056bbdad0c26b456d9f8b569cbad94",
        "7d059fd509a5e2f1e06f4fd215f3e109e8cf12062a8483dbda859c1f1df18070",
        "7e646be1c39f9738f448b5a685fe6145c1ad6528410d8279a76825c83598e00c",
        "8345d8f27e9be418f0d5181d3ca4bb44c0a70b83b9434661a731dd925239d9c8",
        "8a525dac5381b7aa6885fdb56da5d2224193b8bf5a9124d2e8dad2fe391c1090",
        "9439e0932fd7566bd46c65bc257663f936f4f0890acff81af9af15fbcf94ac86",
        "98ed034e247caac2061b4d6cd30404f9a06f3204afc63f6aee797cede7c05f2f",
        "9a7910ceeb40fdb737b12e25df832283f3a6982e48e108ff18da1fd3ea360dc3",
        "adc57f08417ed17a8ab63cb2d6aa8a9d4a7ccc34008f14f335a1ec54b6800d95",
        "d0a46b711003fa64af35e534578d9f833ba20250bacd25291672c813103c1d33",
        "d3df703629538b3ecc1af8a0ae582e6f4aa3e788773f33dca86fa8046b7ff067",
        "dca6e860622f6c5ee66f393771d9ec09bfff141aca236e0f3236422ad8656c48",
        "e6b63a97d131ec86d3c78ed050a318d3f26d4e2a931298c84977cc9505318b21",
    ),
    "LGPL-2.0": (
        "e6f0c2e0077b52fb40322c6d921a296aa3c9f307068d6b79e98d196d2bf84577",
    ),
    "LGPL-2.0-only": (
        "5fec6ec96782458fa84e4a0345698c8e56bd899232a40e066bc2feca7e1f3f5a",
    ),
    "LGPL-2.0-or-later": (
        "11bef2fd1e8f19d847a8137cb72e3b700797a85dc408a75e7364e70ebeda6b98",
    ),
    "LGPL-2.1": (
        "0016d50181d8d1dbf1ae66589bb41743df8c8938a300ef7abed9edb5a1ff8735",
        "00b29ddb51cc9957fee536683029a486c4b9c1e2a84a550907cde7fc5f5a4b1d",
        "030e007fe53b2a3748b8a1b6d7aed31235fa95688df91b04099a223346d01759",
        "041507a512ef01daecdae60c44cf277b6046accccb9098565f62a3e49b4b1069",
        "0b0a4ec1d10ccb5b0412ed07249c5a63cac3eb32a61c35c42d038c15dbe28fd5",
        "0bce234000d3145ee6b4de5386dbd60c0bd16f3ec85418563c56bef45b9c6969",
        "0def4ec00852d591cf055e45baec81424deedebf3aa1f34f50792c9405109dd0",
        "134585d5aacf9e325a1248950269b9079cfd1852b71a1b9ccf6ab2aa7fb6f412",
        "1627bb7271350d1a9474b4c714e4274d5e4f4131d55cda97a3426548eb104867",
        "16eef0e425e81d04f1fcb2e7c1aac2e3a2297041dc10c559efc582e7b4984969",
        "18b23584aac11dcff065a29f20e36f459068ef2eea53ba959211f1d182813086",
        "1ad24024bf3af2b88f48838cddf06f4f80db7da92a4fd18be3c601882eca09fe",
        "1ba1f24b2de7da8b5f09638eaea2e525466700cf94fcf92e2cd0bf8a6708b0fa",
        "1d4195d62103b8373edf4d693b63fc115101a651ca7a6a739b1ab4b15e3ae2c0",
        "21ef86bc1d760ea424b5fc15ca79372f8edb7453a1833dfa62131cd6d482cbb8",
        "2b1b261464167459f10aae9f8db0d668287e6b251b60b6a01e532a00ef803cfb",
        "2f4537bea8eae2d2323d781ffb571af91ac8041e769ca447d421ee8560fe8ba8",
        "33dbb5f3dfaae907f4a245d291edf40a0d95b34cf3f669c171ca234abd50431b",
        "357714be729f0ce22c6356df39c0450f4fe818c3e589e5d6fd46c96fee5c3fd8",
        "37e6bc1764e3b7f4b7bdc138278e37da7a60fceba9135ac3edbd46b4da0a367b",
        "38cded80f4b5899c38755de47110deb26ea2741838606519a64ba0ab8d0f0f52",
        "3f15959cfb24aaf3fb449a073a63abea1b94d22cc1bd01a0135c5feba0c09892",
        "3faaba4d11ddd028b77c19c6473f5a020e90cf80938d953559216108eb3386eb",
        "41d744444817a495b871b370bab9895115f6fe23666f6d9df763d5f67482721c",
        "41e865f7bf58543165658175bc8094d025b3ce2ddffe132d2c616f9bfc7973ac",
        "42419db26ec94f1d6437a23ddf9663852344d1906285ded7a1ee71189227bb72",
        "45f06a915ae70a4bf36d7de7de1977106142d3f1ff279e96e6f4928a336ee9cb",
        "4745b77e241c47ab852543c561509bf50eed17bc1a30b6fe489b25570157a75c",
        "495af977925ff2a723771b7a3fa522059e7a1ff3523a5a92b48c2999ebf0c45a",
        "4a5d79701843f9d02a602eb4241ecb14e38a37ada6af778b0fb1882106fe781f",
        "5278f6f7ac1bdf8f104b98b4af13a995290723f9d01e6fe7a82b04a5c11eb958",
        "53306bcb56ec99bd10cf2ac428c45fadae9f4d1025a803b103336297021a60d2",
        "54ee8713e3b68a5e13b1d428387d9595bcb34fa63eef70b9f5ad3317e6060c5d",
        "55cb84ef4e73e8d1828ce9795e98d731323a10de6942a89e47b7b1292cd5c8f5",
        "5aa797f7445de1dcca7608b7347b3fdac91f31e3d529c737eb175d7c89e47f15",
        "5b23cac8533cff2a54f7a6f1b2ce100d4222d1d97ddfadc696acaf9708f7fa28",
        "5f0332155297ef188155f77af8d27fc4bc156b073c4043485c22a6341520578d",
        "6212f3c517af1deb749eade041390484418b75f98fe6533bef0645769c5e8292",
        "666b0cba7e5a8583d772418bc926302cf193ce3119301a5ad329a9c67051758e",
        "6abc748c34c8e0457af37ee0a832b93c1e08da0378cbbae9e42b439455fa377c",
        "6ce5e15639c9d78bc62b68c7e0830546c62956933f61295c22a08617c67c4e9c",
        "6f284fc0d71daa9dfe908bead7a51cd272014165e0720ae791329f3a8c1c895b",
        "7002d883b8d7d268077daa8652783d52fa9a0ac2d74005f45650fd4fdfdbc9e6",
        "719e38fb41160d1505ba01c46dba62688dc893f01ba61f7ace2038c1c8f5889e",
        "71eb8f8b446441d2263ed1b079b9aa252ff930a53cc4e63f208380dd64c7dbb1",
        "7215c27747294eb393cc6d907a48a245561c6168225849c4beafdd042622bb55",
        "745197f54611e8a1a355244237453208c36c7dd5a8c493a8d3afd5d64f82ca76",
        "76030333d5ec67782cb5852e2df95cbdb397dd276b70c6522a8b02dd44cfa22d",
        "7815dfca95d921ec1f82ce7374438be636094941875b1eff3ff7669ad454fd34",
        "7909525e234cecfcd24a3f1fa8c905ee8d59f9b18be36ee52fdd10213f546e61",
        "79721196d6c362133e850fcc5c05c4b794087b52ba14a6cbe892cc0ba85d3458",
        "83666979a3633ed179388b6a6ae53c91468407e088b86366b1bd6f7fe17965b5",
        "86869c66233cbd7a7d49f7b3748e6b8945bc7b9d0a9389b32d817f593ee7ed21",
        "8819f9c58069dabdb07ba167dfad66ff224fc2a39b1923f89458fd800b583360",
        "897a1bbf4e2117b73e15f66b328b1c085dd06c667a2a3f70296c4904e22d62e9",
        "8d790b9b9c71f8ece27859acf5b456e90ad9332a578b8eaf5db783c4623b47a9",
        "8e328d7c7aa055580ac81a6b40ba1f576773f940bfb597140ea041fcd0126ffe",
        "8fab93b39110a979f0221dc90b155640a2f27b35501cad25e6d41a41367e883d",
        "905aec9e864416b8884026aede538a9cb83af1fff7dd7008f0a30547e9f29686",
        "9430886e0e7f86519144f358b7fe7f61b1529aadc5df1e6d41c73a5c97685490",
        "94a02886d2850dbb4ab9e081094a8c5ddf223d6731ad18a1b2eb09fc7e3d8d68",
        "967fb556da1301d9ab3bb374f77e0b3063387d01f67310a76160d9a4408e8c0e",
        "97364f9e8445498b80373878f5321df4c76ead02e9467e3143810bdae298ba56",
        "98c9cc0c461fbb009955fa01cfd9e8478717d8ae26c8a2bceae800c4e100daf6",
        "99358449af0428fa57e3265cd417dc7e56456b83129e0e69c3c3950dc6efce99",
        "99b394eff5e4fecbb53094a6680f30c33ca389bfa88263802abbe5c1d8ce90b8",
        "a211008fbe2ffdccd726bfbfbd98a5a855a49a8a71def176b45d357065c64560",
        "a212ba39de61b820fb35fede2a02a6faebb239be6e1db343a29cf93651c55049",
        "a37f44664e47c48c76d6a76b00a673a281652a1acfdbb08adfb1f342b3cb8d84",
        "a3927353e4424bd24412fb99d1ca2fd14232314ab37134a96869530aed5d55b1",
        "a6696620e8c71ce566e5a689d837b60aa8926d7c8198737255f52bc4651306bf",
        "a7016a42a6c381c090baea874ba62bcbb5d57bac6bf6f2c9d165c4336bc6158f",
        "a860127a2ff0005b04d90052e1f9172ce7db1b8d534d137dc79aef7e0181260f",
        "a87395ba1c23e3f88c37f3b6ef6a80cd04c5001cd50ae12754430d7ea61cb3b5",
        "aaf2584f402e966e4b3dc11a4bbc73d45ec34b546635b46d143403da10b46c81",
        "add639fd8111e2129cb340d803efc468604eb7754fb9e5450ac27f58fafdf2b3",
        "b201afa0f3f5740fc845bab05ebe709852392ffce724cacce5211b7bd076c685",
        "b4c9138abdf2bff9e518e6ecf59ce4aee00f382e3000c2e4065fdd5233d11816",
        "b5d97d4736945b47a816e228c0b6ef29604a91c433735b718e7fa88d144565eb",
        "b69b114dc8f04787ecf9f8a06c6cc6ab538276bb73384ee9578698cafaf9c408",
        "b8bed95f54dd931a788a25e3565efae54664ff69330948c8ba963a353e726ec5",
        "bd6bf83f2cda342b2286c0306731a9e5532b95bed0cf9238d39bd9f961c1b809",
        "bddda90809fc7993b1cbf3af019ff03e081d23b0e24abf0e6bb7f5f11a39ac02",
        "be205f3523b08339daafd344fb7964e473678c063d41c0a362547e504058841d",
        "beafe6cf5dc6bb50abd05b53c111f807de1f58443b2b3133763695e058d859b9",
        "c4feceaf0517859b86e0a92f8a847fba89f4a7795fbd823badef63d02cb2fd2f",
        "c851fef656ca43d6e99139b6efd62f1256732349c681eecadd3b3f8bf7745396",
        "ca79c92cb95c0e9378856aeee0bc8b3a36c5fb47aebf896297adaf3bfc5ae714",
        "caf3caa8dc544b0639f9c9274a5dbea6a843b7ac6d9950260750cb6109a5b1cd",
        "cbb8388a318bb867156812731ab4d4d0ab69eb44b776f6e9db29bcadad63962e",
        "ce311579a7cafb04a272a6de5d0545f47cd3486d37b868e9af4c563c613b9ade",
        "d4156ac97aa7b7102717660971c6e75cf9ff4bebd12586875ec13d6b47787540",
        "d4697a4a0f85c52973587493dc9420902ed8077ff52c67c9cf1028eb0444f897",
        "d877d4eac4f75fd63853108124d0e5510c4021599efdb460220b38469b0ff8ca",
        "d9285e1dc7e6759b2665b4fbff85e0fca026b57434ac555299d647d26169baaa",
        "d97e9ad3ce19921f117ce0f59d840bec13c0cee2e5617950b54fea78dbfad64d",
        "db66cc9f7172872991b138f3be3f74bae569f485f5fc6935f3c22e3fe405f639",
        "dc3c47e57053d1a69429474321109cf10281533c4437f6dd0eb6fa8cb5885474",
        "de68e325d1815e43e672333ec1d9ad80b3d8dd9533789e5d6d140da2c43be1b2",
        "e49e3235ec27d38595638f1ff69afb48c2f6f76e3d2fa4475fca50812a2aef2f",
        "e62ac2fd7bc197093aa9a82023e9d4fb5eed1d337399d34e13797b38e0eca8e9",
        "eb91575ab918ff07faa4fcf9569cec189d918ebdcc2eb18d33d8cb0a880e09b8",
        "ece46bfb225207feb73112045381d184c8cbad2b845101071406c9e090ce2cc9",
        "f4748856e5cca6ea7fd011d527b553e0a8f4b250130fafc4f7350be838789640",
        "f88e5ef204af60b2bf8131a17eeb9fa406cd38ac81f0250904374e4be48cc231",
        "f8bdcfccfbbee812834bd6528ba9d32cbce26eeead31790222c428b05d515df1",
        "f8e9161c665afa7f913acd0183d4e34eb3d851ae0add3e46667ca9ec12103622",
        "ff524229957c23b4b27bb36181fd5af470b452529b10632ecc3f2f1ca6be30ee",
        "ff92d6b256b035b66130b31f0bf8ba7edcb8efc242d03547e4ce162e4e4f802d",
    ),
    "LGPL-2.1-only": (
        "8ef29f7ceae179835f69369b48873938e2ee17c325560c887ec408856e4336b7",
    ),
    "LGPL-2.1-or-later": (
        "d7fd9fe036e8f274f14a8d6246284daff913551896bd7154d0b9eccd00b3aa5e",
    ),
    "LGPL-3.0": (
        "037a8eec8d8f8e14e1279d8702fbe19c68a1243c588a9d620d57f8cbc0bd9256",
        "05096c46667e34b620bb1874ab6a53955f43aebbdadffd72b1dbaaba4f395f25",
        "0b77700f9aab83363625095c31ac94a14d0e6eb52b60bfe5b2daee0cb136cced",
        "10aaa6416664f8a1e475e9f15d82414941ab1a02f29c1a7d757bba7024ec4f29",
        "139b386190b69bc57ec8bd38534a393ce2e9b15be106a7d7a40d9948bd87ff0b",
        "15cc14bbf407be32352d872986eac4c26a1421952b17d4bb669036c8ef2b0a68",
        "16f2b9565f54a48a1fba1763ae46e42e2a5978fb7ad5ba96d201c260444578dd",
        "185fff83ce6aa098ce4ba1349482d100d23af13c77bc8b87f68e5a5435e77ec0",
        "1ba9d7a9d6dcdb5e0229f07ebae34251b3584f0a99927edccdd07058937da85b",
        "1c8cacc9dcfb027dcbae9f6dc247cb4605d805a4e360f50744fbbc0b8ca139f3",
        "1ecb2477824490c0b1ffbdfc7dd9ae625a25d4535ea1ec4cf8c717b8a5220a76",
        "20da21fff5369833e89865dd71138c3bbeca0f3bf76b96fd82fc6f952f483885",
        "24b81696eb98dda9d8169e5a163c2efd723805a62a3cb4ba22bf3517d5feeac5",
        "261c6cd51203e8b12083414a6d1826dde12968119d08b301025d9eed7e52c32f",
        "2c64ba10edac43722d2798d11f718657dc2ac2f6b5f43e9edc0aeb6417aa2e2b",
        "2c675757a3ce3f6d6f96b3020f13280cc9ac8eb22e1b0a06abd510cb88393628",
        "2d634690eb89517e91d5b05da08400bf9834274988e195e7558b3370e9fb456e",
        "2d7c54d1559115627fc7d2f7060f348725bcf86bf292f526c9d45bc20d405485",
        "326fe456dc47527bc5c5d1d1fb3a12b36b9faca0dad465d9a55336f374e84d78",
        "331a7e15897a0bc0437547723ac5666b2fbf8b3842c6769f9fb017c15273d128",
        "3a67652e446baa0ded97532afa01d8ddcde2006a146b882e9ccdd1e66427a016",
        "3b6153e7197c189a44fb1d4f02618e562c7f1e24be48be76d5a2be2f918f43fd",
        "3c4b8c40dd66e8f0c9062c02d085d51c44dea5a9f8816dd666b0bde83223fce5",
        "40fdd5bff57e2e771bf59f360f66a8da13f42e9e739ff40b58d0e6c550cea52b",
        "43f078e30e453cf315f17c13c9fc6127350db17d21326caa616d925fcd97bcdd",
        "4490e75caa05d979524ca63a762c32a3f2fe37f94204a1eea7100ed472f954e3",
        "472324b4c50c53f70828eb0e05311217395129db1d68346975532269efc79e8b",
        "4b3dfa11bafb259d9a4d64245d3405333ef36c1a6b927e6547f00bac634d4dc1",
        "4e069101f915c46b9c94ba330731090e3849d0e78f7b3d1919e50ee58fac9577",
        "4e5077df4ee9d81f1beff35e6054e6f88124dc1bc19482731bf653b13d14d8ea",
        "4e6b6f4e3913cac007b65a225a2fa827700265ae0bc164dab39c09f3f2998a93",
        "547a0f94e8ba2b3c372d2ea17c76fe0c8cdaef0c7d72101aeac32412c9c74b7a",
        "576ff2ff8845e83b6a9ae6b2ea3c8091687df06fa22ae804d2f718c1e7a65014",
        "602ecfab0d2bbe799c20b9354e4c508fe76c3516e7a2edb39b37223babf543e2",
        "6037efc3277ea30a2e704f6f6bfa6c516a47220e7830f1d28c10d13419459edb",
        "612f01b066c4f1ea843201ba1d377063cd155734122bacb695ac11bdd5e9ac54",
        "625b1b5a5921111eb6ccc506aeff7e26f4bd6569902b8a2b5de7df4c52b11ba1",
        "6afdee002e3dd70add076d4e512bd85f004f28babfdac07945a9d10a8d3025c4",
        "6b27fb4d8cf2e0b56af8d4a8e00f96277bfb953998e269607e2c3d62d022c2a0",
        "6b79f405f9df72c5c3d12a73d3e168eef999e09013c7b4583f3a46aecf0286c7",
        "6ccb9d9de20ed029515f335e83fa783d2f7395187e52a8925d358cb153134ffd",
        "6fa946371cc03715ba69c1cff4a6b96b042c41b0e120c7fb245359208ad9c4f0",
        "7070171ea17f2398bb12b226a91c4f4b7e55ff12a9fe3f6534cc6e2a52954689",
        "722b18a68c772c52059d4af832d8731c03e4995913bd573d166ff3641c413518",
        "73e39d544f7a2767e457a1eaf8e4edb096b8cf7f931e76a20515c68b0d77d2cd",
        "76e04ed1fe9b5863a402beb5bd3dcb29e84eeb2003cef14733ab2b61dcb07d5f",
        "7799f89e439c442b2bfae78a5216470c2d2b35bc9f99e4b0e0041c912f0e3fa1",
        "77d3901571043bef2f75550ae5c97736ff15d255e2fa8f1f12209479510e7b25",
        "7896136a2420945a77abd5f6c410c4b41140488bab92679a1efc1c05945c0570",
        "7a8140164e86bc95b6053f054527051372efa4e31e82a08f2cabf79ec24ba4ca",
        "7bab9f1f0f7d2bd177be1f339939891746b03aa509b08493c610e358eca0a8e3",
        "7eacb2a8bdaa5995c44b7475751992f08a795fb9ffc2d0246b1368512754177d",
        "7efff8818ab14b6570e55bf8326926de3d2b4d93f5eb9c83c385ed9b150b87a6",
        "7f0a70cfd8e4551d1544fc28bc95db1c35aab62cd3e576f27cf69da4841aa8e0",
        "7fed591cc56c9746c708dd8b8e3f2033b4965335c09f693dd8e6cb761bfa86fb",
        "82d353c33258e3f9ccc6b7af5cb4b49a337b646e1ccc455c0805ee22ba1ee10a",
        "8575084ba5c8a8f0e8970d0e10037304a22277ed0929cb1f9d6d30b11d9cb1ca",
        "86ed1661e10bc054f236b838cf9d14b59d3645807b942b2523721dbd47fb7809",
        "87397b156597a7e727ffe06d3c0e733bbe7f857142b958ae99915c1587d7fe56",
        "8c6800cead16219eed09ab1d9d954095a94116035ef572af4e22a4106e24585d",
        "8d9ba648f92036523a9c058e9bf894e41efb2dcb836fb66fbb79741ff879e76a",
        "8db51a51c58f1a35acb7cfd50bb35b6f564984f72b14d8dbba01ca57f71085db",
        "901766e78595d5ae79b8c464e05d4498a3023183825856045efe4d0e888ca7bf",
        "91855a781e733b8e8d311677381e7de22962ae839f6dbe83a4b37a8aaa92eb93",
        "91d5ee6967c7ce5bc7ce027685d1577babae97af3551cc08c805803bfbaa9bb2",
        "98a3a0ec842258b9ef7125d402117ad54fcc2812dbddd896e3983e6674ca87ee",
        "9add40462610d335ff27e4dbb75b472e17acc1db95bd700873ec2580a9361650",
        "9bc02216565c3d8d12bda7f74a1dae565c72c472345d5b58731cf7e3c5ffd7b6",
        "9d18d156995a8aa2e9685b3e264edd22d07c990c39471159882b3dfa5775ad0e",
        "9f96e198673efdc2f13852e972dc8adaa438c6a80250c6455f76a7c0e69e7ee6",
        "a5ca0a4c1a853466b19aec5bd8e6a7baa9e61394951d1487755a358e9ef2122f",
        "a8a4b2bcc60c4051137984593c0544e5ba7ce80f75784aa946c86fc2947c0b1a",
        "a8b99f16a16fc6ad5fcbf81f6971f2e6816efc1d4643d3888e720827e70eb788",
        "ab57f5ddb0589846f855ce6f4d5098653abfdba1f57252cfeea2b90e81dc3da3",
        "b2a5a3771d4f77cceea39e9d3c8d6653f6816f6c68c5a5519b372b7de1b50648",
        "b6805304d2e946f1b89f79a34a1d324daeb323b05a9d9571f96f091ac300f01a",
        "b87a40c8bfd2c697968913916b312002063138bff2bda7fa74861ce6cc8d9a6b",
        "b9bf55d944fe5ec51aa67b1d148fa58e883fa66d1c424921e988fba25fc49241",
        "bc2e6a7c6c0926013604f9ec70924d4079c25d855b95249b6f2b67c56149cb12",
        "bd1aff20296d3e78fc18713e09fbe0d796ac3f6ea42992f520344c370f2e325a",
        "bef7beb48791f798b65059df2f090a289fa91608bf2870e254994be404e68bb7",
        "cb84b6a708de85cf41dfeaac9b62903b4cdea163052e16263dff0d5925d3a5e1",
        "cc225bc09596911db65c99bd1bbb706d1470b52eef1f18ca03c12677ad11f341",
        "d04d9dc48d9106bfcfccf867af7394387b41ed92cfcf40d4a4924a90062bb97a",
        "d2289e50b6f2582cc338dc6b6abee4ec71e67289fd41dc1225e71c7c6d09112e",
        "d4946301c35d9a48ed4a10fe7624f1d9b1b7ad8570ea8a73849d740da572b73a",
        "d571afefb29c4e3d444364940bf13ccf016c6ba7ad564e102fe61adb7040d04f",
        "d5eec5541968474bc7a47b656a8bdc4a6cbb0f750da1dfee9a462f5b7eec51d8",
        "d7e9adb0773b6284bcf043e5e3aa6c425c9470920cee1d18254a7fb5eb1a3b5b",
        "d7fd59a7cd28d7e822141cdd5af53e8e5b89264a8a668e4ca62765499de12122",
        "d9f7b7a87c76cec5767c11abf2ac90cc7489e9f3f8797a81510fdc79c6e9e810",
        "dba7e2d7374c3f4cef0eda14dbb93d69dfaabebd8808bb2fe980358772449dcc",
        "ddeac6d2c3574279ed0d5c12d67d1b87b540937b0333bc4ca4db71eaad39560f",
        "df10b2f88d91079a8c7d47cb2f83bdd3b75e59f2d796e02142db6c9fc14c451b",
        "e110ed1dcf027b1490de9771db2c0ff0385965c5d21af3c243acf3670b33867c",
        "e5cf8358ce5c6bad1aa880e1c7b776019d345d76ad841f9bda5e91310c42de05",
        "e6fb97ac6619b819a80389f3173621e95994caea29ed39c2c921bb9f96fbf4f8",
        "e7c536dbabe7fcfe1e37debba92da5c49780d32f6c4c4f9110318fdb08340119",
        "edbb081fa0ffe66b650a23c32b30f44fe95b90cdf3d414a0a6b07de1a4ee7cfb",
        "f1343619b682c8c1212e92b7b0b537637d3eace527556cb3951faaaedbf41058",
        "f1e5ec7e3a6e8fe00fa74e79924608b2de0d1ecc729b229138abcc2644d3186b",
        "f75480f89b2350454701ff7a883febcb24249c077d7097609285b90d9038a5cc",
        "fa278d659f3794b0f7720d75dc84c7853c49ed0b7199dd1c58a533bac013482b",
        "fb9e0298ca6788754b275f5016739e2d106dbb5b33eba059428f79bca8c48aa8",
        "fbc86b0749a73e74a6079a599ca3e2f32d77128764cc66d8347880dacd6b5710",
        "fcb9be4734493bb5d1134a5730dcb5e85a02488c708cbfeb88b568b3414e4a75",
        "fd02e77741e4e64db3bf8bc34c1c4b86ac218fcd95f5c8bfba7acbeb49fc4518",
        "fd1120063370a7afdae0a242b5990fe6936f5feab0bb911dc4a156800616941a",
        "ffd1f86206072bd7640c736aadd336c4bfcbce44f60f308d71313309f6983dc5",
    ),
    "LGPL-3.0-only": (
        "980cc775a502ef5664e72f0c39f8e2ea5a33f3f7d58052fc92d6ac81f60667ef",
    ),
    "LGPL-3.0-or-later": (
        "45adc89be8a4836f8a2968630184a4905190dadddbe0e3a4c88c01ccc6ec7820",
    ),
    "MIT": (
        "09d3b112fee2781918e87e9b974ac6b3ce69e893bea3beb6df81e98d02855b10",
        "27afd809b782ccf7ec52b0da2246c9521ec7c37adbd411f5266c416d820bf3b1",
        "2c102a5a792a5975e5614d5c84770dc4298bea1110bb89343aba69f23c88de62",
        "2f512ded1e5280cca42eea7a2db1b8bc49308296c3150792d0a8e293be860734",
        "33d8099a8ce10159d0922dc316e8f7aeaa8d0df661017392e10553876623f6dc",
        "4545fadb4a58410ecf61e4b4045ac893b95f5bb75089e54b90153a462665de58",
        "51a3d461308c31965e6884273416ce29eed50dfd8a8c807f6c1950d50e8501c7",
        "59b50cccc807c7de9506e98b6aa0127e911ee66e1bc3cc92a9ce89b39d3d83a0",
        "62ec64d90f3d9cca385b6d90d59a66fe4390c43dbfe484bda249f801da1adcdc",
        "67574122259e9d07c36e13bfbf6eca940d2e42b62d80f507c00fa7542b3b2580",
        "6e1806bcb91007639aa7d89ddb7e7c32790a6b42e362dbe90957dead5c10c915",
        "7066c728a8e145da8de8488df7b7e5b82f690ccccca4573da7339735921eda20",
        "7fbaf2db7d755607e971d9e195d621ae6732d5ef79e2c59e7f42dd9bc54d540b",
        "85bb9fc88a2d7168487f921ac86f33e63d297f1f914bf26cb0e338d532217556",
        "9097a6f91d3dc8b0fda1f15997fe61366c0e99348c46a405c49789625ab11caf",
        "9a3264f947c6492fc24751e0fa72d753768535fa84f39c539f59161bff01e35f",
        "9a46d7ac13a0001ef11761e5cb34b82d741b7c3c74615216031bcd32ef5cadd5",
        "a2692351976a19aa5b7c3a4939457161108dc07cc0f7490521cbcc8f57f99053",
        "a85eae3d4348c503f4bf7cc0fa6b161d3e56c5ddb85bcaf5475e5f7ae44632af",
        "abe2f2808d14ca5434c076c9ac9610c6b846909a26ffe3b013561a9cee25d4fd",
        "ae7c07a2541a2befbfc7ec7f389eb113f1fec11d5ad30b0526b92a5d0ce079c8",
        "bdb517b0a6a2b93fa94c03cfc9ccb8997e00c04ac984c4bbad2b974a9995b083",
        "e2504ee293609bb4a2f98c6f64c1db8972fc418439a5c92c531af08c0934617d",
        "e7ef20201bd4dd046aa64b26ff84c124d9ff1144ff5469382daa27b74f3a6cc1",
        "f191f5007d00f1b971cf7dc8c5a881b6037eb2ba7936bb5f72c7c9693041819a",
    ),
    "MPL-1.1": (
        "0530db78c039a369fe64320e5971b8b49c8c134a79b1ef0bfb221c9983cfc9cb",
        "219a33ccbfdfd4d6ab42a207e177375d64cbf33ae96a8788319aa589f8218bcc",
        "259034bd429da8360823accb3c3ba7139cf7508d2e276dd20d21da6d7ef72ad3",
        "3b554ffd747ac81c009b0ce71af6077eba5e9752fc419aeed03f5612e0a67916",
        "4030e5f3d02c6aa6c4046829935bead0782dd33e9a91bf62bb2445828270edd2",
        "472310b9a43e949d4e7b47d601c121818ef9dabee1bf32b6d233fb387cbb3e14",
        "4764e29952322676d9a1242b527f308bcc38b26a4d62cba65ec89882f4fd433a",
        "486e4ce413da681ab32bcce3557b97eea8023ff3c676bc9035c8ad89200878cb",
        "5971ad2325c0a52de7a3058c446e1c71a1a4a87b40586ae453fd17f1f04f96f3",
        "5f8f627db3aa242fae7199c9fc802104eb49e826b386a02d67329ea044e6926c",
        "654476552c5dab6ee681a2093c2a66df118537584a7560c76f89d82c4e6f6fca",
        "6914a1014626379e16c441a8545002d296c7a0e73f0a94daefa269d1490df043",
        "85ab6f7d11b1640b2aefe24ea318c6c1d73ed97bb859b928ddda273efa60ce46",
        "8b35bbe8f9a99270175c873b8dd4d04fba136a0a8d51ecf110586a7287d2cca0",
        "8dad6c91216c678d80ba898181aa7a981afc9eeb750c92ff28982cc94d3ec080",
        "905bf2943cc2303d275b9f007b521bb271e18b6d0c3085ec1ae6e5a3168ef441",
        "94aaa6396bf274cc0cf14e7f86ea4049527e53d68383682ebdaf67f8a28e9c94",
        "94b71f97f2de37858604d8b7abb9f7f63c99f92dcf6fe24013099f9ed5d95560",
        "9ca8d78b95dca8630bf8622859632facf4f869fa3260b7dc52f9a0cea65eac48",
        "a535619a51b50f5a1cd0c2d81b80b3ec4d6fd185dcaf71eedce9126070eb24c2",
        "a70b1a739e62e8fd2fa9b368ba6d89c524a612e3b9c7ce9737775debc341054b",
        "a7eafa18908f34a9fcc07feb18e5f257db512876b48daff3f86e7c0c0018f0ad",
        "b090a2ddd437dec865cff03feb5810be4f0b16b5435e01133b454a617ea6c4eb",
        "d123ebeebc6cbf0b63481a7cc888b4a7d007f586f6fda2ede0ebc476a19e4869",
        "e15c4f996e6f08f526080a009087cc4d963f106c39b08dcecb3517907a2185b0",
        "ea15907e8fb41fdd8df116dbb1a15342d23920f5fc7ef79a52fefff2c04e0195",
        "f7615997007b049825e1e253d8cd27a44069c332575f751b4a63bbe1382e2670",
        "feb9edd2e3f1d7422010a9c82cea252fcded5580c834ef3f26e10fbacf31c332",
    ),
    "MPL-2.0": (
        "02b2302f325981a8d93cf0321205596beff2b2b11a8216200aaf9984c2417d30",
        "0635369ff052eb6a7ce010fb03ef262d3b447f041eb63aded1529063d37920f8",
        "0b0c39d42704d0a8b1075be09bc85abc93be5697e7f63d3e3fd9dfd164124a2f",
        "0f9a172048094027d26c73f59ba79c0acc5d3f999a4bbcd5d13237a95c23cbf5",
        "16edebac5da91e35d7e62897daca82a6d8330c88774c8efce2109bd05fe07f74",
        "1b5b31c3c98f521d2f7a87959d2d3c4de27a9da6119373b4962e4295c1a422ff",
        "1e036d9a102229a227daa2fdea438183761312752981d94b588a1e847ab6ee8b",
        "29e9147cccb47e88ec11fa3e3bc1f59d7ebdd20f49f049b403b80afaf1e9b196",
        "30434fad104ae7bffbb8cd6912d9d874e43738b29f4a67516d4c55d6325f3dc6",
        "321eac61acd72c51b639dbab6d27b84b1e1ccfad51bfc8292776ea5c9f2656f4",
        "328bb4e5ece4143babeff434d4479e1983a9e281348e397b0fd109de5fec31a1",
        "337aad74e675283b895f315271054d2bc43b0806e56e666c6af5ef78739ae3aa",
        "34a7175ef7667f7638aa6fc7b337644c62ad4fc9a8bf43e23b294331f93a25b1",
        "36e0b288b29a44267f96db13dd99733af69b7010c57fd0a1c8cea84a2b5eef49",
        "39a79e400f6b6fc0b30fc8b2e85534bb1715dc6fd7cccac3e89ec7ba002cda93",
        "3d89628ad3398549cddf125f0ec2d9f2007294e89a385841747aae79742d2e10",
        "3da7ce06f3117272acfb21d0a1d475cc3f8acc508cfc67a978e439b5b9de9e3c",
        "3e71303637a4a041d73b6c459ca3728cb62aef31b4412b69c206709f56afd05b",
        "41cab5fdbd04ee105418e44f76747989ebd0f94618ebb702dffb8bfd521ede1f",
        "46836d49bd3e728937cac4957b3e7a9733eeeaaca69fd63180cd74d2264bc429",
        "4a7078c599cc5204fc62beb81338d721bef22089e214cb367c4e2cbadcf80a12",
        "527076a535dce0c8e2384e0f2fb23728c2b42a8e03a81a09f041460f03c27eca",
        "53d77f9ffb410bfd5f81f37db3cc8bdc5218ba5d72fed3f15d381770f1f13822",
        "54366f0183b00523b59d97c6dd05e0cd5e1232d196a8b4e3053f667c81961ad2",
        "5dc4273ef39f21b3a633f6dc409c13f412ca8d9f0bfeaa2369226ffec1eb21c0",
        "6025e96b3cd59d42113a4db09fddcef2b3ca1c09dbb3d849ee43b29809676ed1",
        "609500aa3a4fd66804b3ce96131d38294667d375ac29aa7c538e350f179f40fa",
        "661111e9f08ccb2dc701a13b5c9f21dbc54441ac49a6ae1f7b2279b1d64df9f3",
        "68718d06b2499e2cff0b458249ebf10e54b2b78b180bb77dd54bbe1f3225a917",
        "689a1c49a061e31984a299267c71f8c803aa09cee74a7adeafd58b7dcbce2f66",
        "6d3dced099c8abd2e4d8f4f7a7333130a339b5d87a504eb17145ea0dde4b564a",
        "6e8b9ef15f2c4a5274825b48e9425a0a235569b72964c601a6f34a1f2bb40666",
        "6e989b9984fc02c50703096ba02c62f22a6a38add7e12dfcfda8f4e23a96583b",
        "707283af8dab4901a1907384ad624ea86f3e07cd999306c79c746671af566e4d",
        "75010f6b7db4d8c5cecf869a9ac489a4637e2c39ad2f3ca55d798b8a68733b0a",
        "78e1d1023feadce5a620317a97246e8d50044db082bc20e640442ac4f43a18de",
        "7aa584f668f9ba289122efe905ba553b61f07b1673abe966192e806f7af87923",
        "7fc5b5591e8ac1b24f73727444662edc241e7b269960c4a4c77fceb854a560e0",
        "80ba37fb88f8d05b29f69a8932ba7f1722390dd75f30d5b7e42f07bc940a799c",
        "8721d3e20d390a1d932e5a630dbd9f0a7c57f3d52d51aa21e6a6d9e209feda9d",
        "8fc960817f248b8a297b52dabde481d99d09fc38d13bdc9f11891e5e7a18cf0b",
        "92d28cc1fee0657f0555b3774b165648a9071be25b51720a83c04ad2732234f7",
        "941e631f9095f965fa39ac9ffea38a96ec011da57c97aeb1f6bfdadb128a8d09",
        "94d57c772433069f68379487d2e8a9e348b9f09c0a258f1c4523f5b916da9877",
        "9507fd33bfb0e1484867daf5943dbe9f941a9226e56beea333fc39dc0c291130",
        "96aff9b19b347fb60296def5650fd16bedc41e124f5324fe8652e6e020651eec",
        "97740b0072f5d083927f2034b4449c6fbf1149d123d93a55eb0bc592e6e0d6fe",
        "98ac34a5bd186b4b0bf0dea38c3e162e0d91bc72663994ab1cf7bc1308c8d8ca",
        "9d299cc532b9868f3f8a9efd71918375cf44ec4a9d5a17b34c5d81da4f0b7096",
        "9da23fe9791a6e687b63036ee6b0c0c519152f1cfa7a71db52981c5b9e03aebd",
        "9e666d95d5838bc07bf588da3bfc6bf698efd95ef50661d93ff1d0946ce971e5",
        "a256b0e97a6a13539676af5159760dc80a0b8252f2038a1b941b82c0a1a9b406",
        "a52f007f790a10513777a5472f5f5aa12fa0afe80e5b19eaf0346553aae1f32f",
        "a87342a42c6764ea6cd4d4f5b57841cb0ace93c0cd11b9c211abba472dc79b18",
        "aa15e10c1a801f9803b7c84f9efcf83fbf315bbe428dae3e9a9ef99b8ecba233",
        "b4db99a5d1a6a2cb3bb213cbf0e139a41354c47277e982e8dc40231a5f48cec9",
        "b62fd5bd2f95e77a0fcd39e7590a1ccc3efe0a3937fdc87014d6d2c040673a87",
        "b9a3011702f117152103d62cae4995fc93cc0405a9e06dda289961a2fa7d67c7",
        "bd18b5b2421fa27873ed0fa503e07343c2c1b2eedcbedfabce9d3d960c0a79b9",
        "be6f50c04e2493fb111875d42584098c11255a301aa137491b7b1396209598f3",
        "c191f808cbfceae361cb0fb2f4d116cba8172522006d179531ddc19817697c87",
        "c49a983b6112d42a6de3a041092f860cf61c28175a3e417fc75c9a4970d5dc68",
        "ca74b40aa881907d4be921a037e8a7db78b192f8517413bf2581c23d852d8269",
        "cae674b970f61ca56f34714e02be9e4aed7f16b7accda61cd8b31581bb2c8372",
        "cc8e46295440ab91cf4352f475fb1bd013654e17cbb16034a2b906681f828902",
        "cde69242db332ef5dd1f0001b15939b308b79847d5a4ffcea804e2f1b0d02f02",
        "d0e33bd63a3ee501dc819893cc4175e9a6412046033ccb8be5a80e0b9eb3844d",
        "d276eb13e2a2486bbe094c14e5f836a100d7806794e4210f7510183db5da6750",
        "d2c1969349f00647b0e3871fc5a542e1ed33569b9f0571e3d638cda93dfb795c",
        "d320457045949cf1f9ea8c275a11d5afe098963971bef29340075af95e882ef8",
        "d458cd6420ce6c51306b09406883bab6f680c2b38e027b382597a6713d39204d",
        "d8b8673961a7e52105fcd3c7d62f6aa7c8b00fb63e083fdbf2a6f6e214b648b0",
        "d952418f696290ace2a6614f910121014d7c188658a7e3bee40d5f1d274ef1d0",
        "d9f0dbacd0260791d1bba5645a79fb0db2ee05fef010e4fccc07319f6adf1e54",
        "e2c1f4f16e2c6c1fe2ae6bc5e842286778e54b8f48245c8b6e88c9b772c059da",
        "f267d3e60d176b0c4acc47c0b10691579bd2bf06c3ca2cd79010a0df62ce64ca",
        "f33ba6f158889bbcbcc291817b712282537146a4efe63a526b440fc4493fdce2",
        "f44fe005b3f67ab1bbe71819065715e43bfcc27915b69a1c7cbaf1a9a55654e3",
        "f66536b0ef0439c2f15c77412c845f49a8375f455bb649f28d57f8a0e982d327",
        "f818a73164d1a74cb8877317f3ca828aaad5ab00c437dea9f40c55ea3301ad44",
        "f9c6d9096d3cf5f357c714c248e34b296a765f32cb02842997f58f4aa8bb821f",
        "fbe96971b1acf51406c8b8beae409dd333e468437b011dbd68d53bd01faa737a",
    ),
    "OFL-1.1": (
        "00037fc0cf0cd843d63ee390b12592d99f7a7ef049f2a2badb7d8d71b40570e2",
        "0c9621010acfa3f542e255123709af613e717bcad5523dd7c3ea83536b14a86b",
        "10d6ecf31afb3ee485e1afc26d3f6cb13c5134bc0c383c2082b55e67225d31f6",
        "21fe3a27996cd7788bbe05c414f884e2c6163adac78bd11e11d69cbc882e0d74",
        "24cdea1ef4830d23de53e395355fc64c1ee96d732f8a7407fa9722d7f3243c3e",
        "25b81b0866c30b29b9e894e8848df4c94c8a3869489c4f0d3278566aee0dc9eb",
        "2ab07e78afe67bf55db7c6f827a2a5fbf902bb5230a10bf037f8f64b7bfa459d",
        "2d72db19f4578a152d59aebdb8fd158c2b13349504897eda747d8fc660b84cc1",
        "3a7b797c1903e95c01ed62016c39fb397341b811b75e58e92b865f32b56cadae",
        "41cf712f145c5e0a8ca6f7275d55b75f999c63b4edc5951f1f010355ce0114b3",
        "504f38b672e47ea5cb70928e7eee3e065f4ab28997f11e508990d5775746e7a5",
        "5a8a186af08410f66ca7c1da50fd8868db3c5ebf2e1b9eecd25206445a2b9b57",
        "5d2b640c10b0d2951b7d6dad3de0b8c1d7dafbdcd6a5b9aacee14672fb169198",
        "65b269b2f9dbbc496ecec711f3fd0f73795abb9dde04f9ec288de37ec91f31eb",
        "85996820238fdee3d762c55614ced3512b0adb108421eabee28009e39bf55f3d",
        "85a2e56c5a52cbf17cd02d55353314fa3041d29bf56182cba51c9d35bd0143fe",
        "86607b40e15a34ff92533e112241b42c2401fde5ed3738e15b478ba7dccd8221",
        "92dbc966eabfad2f9a0892228f8ae8043575bee052980aa51132758dc9d98f0e",
        "94a66eed5663db8360ad062a726392b6cc898302db2e9f28b93931c49609d057",
        "a2b621d11cd1808a402e518f94022514a8175085189a52730c02cad724cc4842",
        "ab25b4ebd93d1c1ed583b84f2b8dd54fc579cea3c5b308ec0fc2af8acf49ba9f",
        "acd6a0e6e9c53161afd7c73c8b190eb7540fd080a09944b8259818a5930e29c8",
        "b0d0e7cc2a8d1e984a5feb8aa0f9275cf6669dadd3c251dfb333567576cba720",
        "bcabf871b7302c01e7b8a04748619b6fe826064f30357389e907a9eba1198ea5",
        "eb840a6ee9431d697a9401c397b0f1c9740ebceac76871dc7e672a5997422855",
        "f30eb01c8908f5a39dce3eb0bcc1399ec9722ca4914d8e24a4c6e253d15cda67",
        "f6af66e65969c737ca16605939e00552e72bde98995720c5ec8d79235b7790e4",
        "fa0dede318762669e97f0424dad9365178a2cca859a906da9d0ce544af99a4e5",
    ),
    "PSF-2.0": (
        "9e64b41eed842074db681d38a77bb2bb4b9678f99856d20ef54e4ce019b4cb97",
    ),
    "Unlicense": (
        "076bc415d69913e021497abb86caabd47b185dfb289da7258f7bd1b24e85830e",
        "0e6e831ea8113842ed06b584a1d9dbd8bdc1c9135d442c427a0188ceacf540bd",
        "33f32c6a9d39ba6eae2d005457d2672f807268b30901d857be3ca5fc02c4e0a8",
        "37e93ce5c666cc47829db027f5b4b821f5acbd0e8a7da288f0f97aa705099f70",
        "4e40d525497ebfb69bc9a05338d5c137d3b4d49c6b84cf7403d6f2ea2d505a1c",
        "4e4a14653615384fbde1159ab26f714489017d0fada2237d9df5c979a538c7bc",
        "5be53595f45474fb8afb8a3bc05089d63fa403925524b335887085ce36e6c143",
        "6528d6686ebf3209c4bfcd2738647c191373b2ddf505ff1efc9898d8431bd7a2",
        "67e3ec65c6f75c4f4f2597835bcb9815008d37ff905bf0a5ab6fd2c7909b27bd",
        "6f47a1eb88e42d577e5ea0a5c8684747947850e371f576e666d97b14c47df57b",
        "74a48aafb38da470f7a3ff75077581b4276cb81f731e0a6ded6b336abb43e197",
        "8484ea139304f136e20d3cb8761c4056bb6645dac1c060aab7c3555eeef92e5b",
        "86134c033b54a8f0e79ab50a9fa15190832d9f98d4a4a9ab55a15836e75a0a4a",
        "8c2074ba2c81b3b1036ca79b6e5ab124ed2a0b6f8e6d6016e0a10fa132170f32",
        "924a78762c6622f139bdd89a5324001e74d9f8803a1edcdf8d90b8d4be1fed0d",
        "937fcfbd1599fe68276fa865a60d0d90502200f374b21cdad388f0a83a22f0bb",
        "984a78c162196bc73d5df2284df0c1e3dda37aaaea52fbc5bc1cf057fe50273f",
        "9ecbd9c2c2d9741b6fcd2a7299fbe10ade1a41745d9fba4862ce8297979a497b",
        "bddd8aed1edc9be5be172453950c8927b19c1b62f9addfef88b5ee18b8511f46",
        "c49d85fa60b414e38184ccf347a4f64fa76a89f5ec163e41ee978bf2852fb784",
        "ca521d7dbc1002b2a0c7aa952b4610407b30ebcd8f5df3b4e523f2ffde8a334c",
        "d509ad4e20a5a655e8742e079c87f6befee8e3209cb8e1a7b22747bfb860132e",
        "e1dd8519c1661ea324fc5e10667a4ebb37a0eb85eea54ebac9c31e11d1305dd5",
        "e3f7b2925eb9f37a52ebb6949816b8b8d8e406116f6a3ce94cfc1ac21d6a39b5",
        "ea78cf5aafeeb32f8edab5d2ba2807946f54d01cea03d1d31c38a49ab384d301",
        "eb79e36cabb046c0d8111157b7bcec1052d3a11a721a0198d28e40a7161c1e8d",
        "ebbe2865ae6a14fb7482d12e9355050ff2a7ffcac56ecb2fecbe9a6bdf806c8e",
        "f093978c0fd8d7279c09e18cd0c6e73001395ec695d92650abe29ca65790f389",
    ),
    "WTFPL": (
        "a42dadf55bf06e0ffeec564a7d7caf3cfc9b4b37232ed5540b8b62468b19a50d",
    ),
    "Zlib": (
        "0351d8beab0d908736d796666952b1989d06e4182934df06c67ef7f424ca9b73",
        "2522c605da6029bd1fd7f9fa350e95333b26ae3eaa9245a65d4451cf965e4892",
        "270a48970627b743eca4d79d5cc01761063f4b682850464b10387be2946bfe0c",
        "2e571327a12c25870134271e03afb998285dccaed49d10f5831fabe3f867abac",
        "4197f545468d006daf9f6619146a974fccc7a50402c4ca4fe9ac2c4151f04053",
        "45a6cd54d444e2fe0dae055ae6cbc97a2e7d070464d8b3ea9b3d8872475b59d2",
        "4f5e5826111781748186734b9ebb19f15cb56934a995fabb7d11c828c5001a4b",
        "57af74856b5a6b61907261cb04dd056628f4cdea51d550a59ce2b318d21f4679",
        "5bdbcd3eeefa86455d35352934c8a303f1ebcf7e4102b6cd04434e76bd5531ad",
        "7d0ad6abb7d1f0bfe1395a03a50e36dff6baa878d73ecc71093b8971a9618496",
        "7d2ba44d7fcf0719607019f3e16a5c37089ed462b655d54ff85f002c2cdd6893",
        "8f77b114e3a75cdab6e646802750fbb4b8e8489b5e9a5c7bf3ab16482c0db68e",
        "924bde41031f170f8f427e2d942c584f45b3f9b806f4e71e56815f5f11a99c6b",
        "98dac158881a7217397483eee8dd1fd4faa2ec9b4b2f56dc5d1b706bafb48629",
        "99e6c6035f2b2259e71a195e4abd92068c33a4ad04fe352c9cb7fae36f62df8b",
        "9bb6ef87a76b6f9784dcb2d0e716fb5a4a23308206e6c84d91ac5b88b81a1015",
        "9bf7f2b223f2e99905cdc4ddfe49f97f25573c671af137cce301dbcb1bd6f330",
        "a2f1f3d4c07fda88c9259ffbf857efa57136a1d383698913eb2e33367df4cb13",
        "a540eeefcca1526c3cb39733398e8c237f24c5925b72940043ba8770353c9413",
        "beefb297be8214561fb1ec622aef4427528796f25bb5e54103b4be6aa036b6d5",
        "c518a7c648aeb891231e662e2a0f90e29e9d31f3d81e2033d784badca496011b",
        "cef1d96516a33cfb839607dd8b39a413e275a4f7637469b472287f2ba9dbcc5e",
        "d42ae587e77318b34a67c01127e3bc26760d5b8bbb1db8871bce08c3932d625c",
        "d8cdb8f8b7fe18c3f02249acc7e663a6aa16aed09c838be72faf3ae2f8874077",
        "ddec8907bd2c1ee3816cc454ae7bb710fd14d276ebe21574d93c7bf75ca959ef",
        "e58bea8c44e082eadf9d828dd68982ac3777aeaf773ebc718c9928ca4aa50180",
        "ea71fce458d8d907fc2ac7388a7884d42264d24ddc77b6c7b16512e827570c0e",
        "f90a8080a43ce8fe263daec77dcd9f719fcb0ef4c890830317d846b2b4855223",
    ),
}

DIGESTS = tuple((name, digest) for table in (ENTIRE, NOTICES) for name in table for digest in table[name])
